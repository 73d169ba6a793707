"""Decisions over products and candidate images: filter chains with reasons, gates and scores, as columns of one projection.

A rejected row stays in the result with its reasons, as a trail. Nothing here
shuffles; ranks and best rows are the caller's windows or aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.functions import scoring, text

#: Words and domains of drawings and stock art.
DRAWING_WORDS = (
    "cartoon", "clipart", "vector", "illustration", "cute", "character", "drawing",
    "sketch", "animated", "pngtree", "nicepng", "vecteezy", "freepik", "cleanpng",
    "clipartmax", "favpng", "shutterstock/vectors", "vectorstock", "sticker", "kawaii",
    "doodle", "wallpaper", "clip-art", "toy", "art", "paint", "graphics",
)
DRAWING_DOMAINS = (
    "vecteezy.com", "freepik.com", "pngtree.com", "nicepng.com", "pngitem.com",
    "clipartmax.com", "cleanpng.com", "favpng.com", "vectorstock.com",
    "pinterest.com", "i.pinimg.com", "pinimg.com",
)
#: Signs of a local source.
LOCAL_SIGNS = (".ae", "uae", "dubai", "abu dhabi", "sharjah", "ajman", "fujairah", "um al quwain", "ras al khaimah", "الإمارات", "دبي")
#: Candidates of a list that are looked at.
MOST_CANDIDATES = 15


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def drawing_word(*texts: Column) -> Column:
    """The first excluded word that one of the texts (in lower case) has as a word of its own; null without one."""
    alone = lambda words: rf"(?<![a-zA-Z0-9_-])(?:{words})(?![a-zA-Z0-9_-])"
    has = lambda pattern: _any([t.rlike(pattern) for t in texts])
    each = F.coalesce(*[F.when(has(alone(w)), F.lit(w)) for w in DRAWING_WORDS])
    return F.when(has(alone("|".join(DRAWING_WORDS))), each)


def drawing_domain(url: Column) -> Column:
    """The first excluded domain in a URL (in lower case); null without one."""
    return F.coalesce(*[F.when(url.contains(d), F.lit(d)) for d in DRAWING_DOMAINS])


def first_held(words: Column, *texts: Column) -> Column:
    """The first of an array of words that one of the texts contains; null without one. Words are compared in lower case; empty ones don't count."""
    low = F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    return F.get(F.filter(low, lambda w: _any([t.contains(w) for t in texts])), F.lit(0))


@dataclass(frozen=True)
class Candidate:
    """Columns of a candidate image and of the product that it is for."""

    product: str = "product"
    brand: str = "brand"
    url: str = "url"
    title: str = "title"
    width: str = "width"
    height: str = "height"
    synonyms: str = "synonyms"
    competitors: str = "competitors"


def candidate_trail(df: DataFrame, c: Candidate = Candidate(), min_width: int = 300, min_height: int = 300, brand_required: bool = False) -> DataFrame:
    """``df`` with reject_reason (the first that holds, or null), relevance, has_brand, resolution and is_local.

    Checks in their order: size, excluded word, excluded domain, competitor, a clash
    of sizes or packs, a missing brand. Relevance is 15 for the brand or a synonym of
    it in URL or title, and 3 for each word of the product (of two characters or
    more) in either; it is 0 for what an earlier check rejects.
    """
    url, title = F.lower(F.coalesce(F.col(c.url), F.lit(""))), F.lower(F.coalesce(F.col(c.title), F.lit("")))
    brand = F.lower(F.trim(F.coalesce(F.col(c.brand), F.lit(""))))
    width, height = F.col(c.width), F.col(c.height)
    word, domain, rival = drawing_word(url, title), drawing_domain(url), first_held(F.col(c.competitors), url, title)
    clash = text.volume_clash(F.col(c.product), F.concat_ws(" ", F.coalesce(F.col(c.title), F.lit("")), F.coalesce(F.col(c.url), F.lit(""))))
    early = F.coalesce(
        F.when((width < min_width) | (height < min_height), F.format_string(f"smaller than {min_width}x{min_height}: %dx%d", width, height)),
        F.concat(F.lit("excluded word: "), word),
        F.concat(F.lit("excluded domain: "), domain),
        F.concat(F.lit("competitor: "), rival),
        F.when(clash, F.lit("another size or pack")),
    )
    names = F.concat(F.array(brand), F.coalesce(F.col(c.synonyms), F.array().cast("array<string>")))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(c.product), F.lit(""))), r"\s+"), lambda w: F.length(w) > 1)
    points = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.when(url.contains(w), 3).otherwise(0) + F.when(title.contains(w), 3).otherwise(0))
    has = first_held(names, url, title).isNotNull()
    out = df.withColumns({"__early": early, "has_brand": has}).withColumn("relevance", F.when(F.col("__early").isNull(), points + F.when(F.col("has_brand"), 15).otherwise(0)).otherwise(0))
    missing = F.when(F.lit(brand_required) & (brand != "") & ~F.col("has_brand"), F.concat(F.lit("brand is missing: "), brand))
    return out.withColumns({
        "reject_reason": F.coalesce("__early", missing),
        "resolution": width.cast("bigint") * height,
        "is_local": _any([url.contains(s) | title.contains(s) for s in LOCAL_SIGNS]),
    }).drop("__early")


def trail_order(key: Column) -> list[Column]:
    """Accepted ones first, then relevance, then resolution, then the key."""
    return [F.col("reject_reason").isNotNull(), F.desc("relevance"), F.desc("resolution"), key]


def verification(resolution: Column, background: Column, content: Column, is_global: Column, logo: Column, visual: Column, ocr: Column, judge: Column) -> Column:
    """struct(decision, fusion, failed): gates one after another, then the fused score.

    ``failed`` names the gate that stops a row (its score is 0), or is null. The logo
    counts for a global brand where there is a detector (not null). Without a visual
    score it is 0.85, without a judge 1.
    """
    failed = (
        F.when(~resolution, "RESOLUTION").when(~background, "BACKGROUND").when(~content, "CONTENT").when(is_global & F.coalesce(logo < 0.85, F.lit(False)), "LOGO")
    )
    fused = F.when(failed.isNull(), scoring.fusion(F.coalesce(visual, F.lit(0.85)), ocr, F.coalesce(judge, F.lit(1.0)))).otherwise(0.0)
    return F.struct(F.when(failed.isNull(), scoring.fusion_decision(fused)).otherwise("AUTO_REJECT").alias("decision"), fused.alias("fusion"), failed.alias("failed"))


def visual_audit(query: Column, width: Column, height: Column, page_url: Column, image_url: Column, completeness: Column) -> Column:
    """struct(decision, matching, authority, final): size gate, the query's intent against the shape, and the merchant's authority."""
    intent, aspect = text.query_intent(query), width / F.nullif(height, F.lit(0))
    authority = text.merchant_authority(page_url, image_url, completeness)
    matching = text.intent_score(intent["intent"], intent["units"], aspect.between(0.85, 1.25), intent["units"], aspect)
    final = matching * 0.6 + authority * 0.4
    fits = scoring.size_gate(width, height)["ok"]
    own = lambda c: F.when(fits, F.round(c, 2))
    decision = F.when(fits & (final >= 0.65), "ACCEPT").otherwise("REJECT")
    return F.struct(decision.alias("decision"), own(matching).alias("matching"), F.when(fits, authority).alias("authority"), own(final).alias("final"))


def master_audit(colourfulness: Column, sharpness: Column, packaging: Column, shadow: Column, has_capacity: Column) -> Column:
    """struct(aesthetic, specification): looks by colour, sharpness, fill and shadow; less specification where a capacity is claimed and the package is thin."""
    looks = colourfulness * 0.3 + F.least(sharpness, F.lit(1200.0)) / 1200 * 40 + packaging * 20 + F.when(shadow, 10.0).otherwise(0.0)
    return F.struct(F.round(looks, 2).alias("aesthetic"), F.when(has_capacity & (packaging < 0.4), 80.0).otherwise(100.0).alias("specification"))


def unified_quality(width: Column, height: Column, sharpness: Column, background: Column, fill: Column, relevance: Column, blockiness: Column, gates: Column, target: float = 1600.0) -> Column:
    """struct(score, approved): weighted measures less what compression has cost; 0 where a gate fails, rejected under 0.35."""
    parts = (
        0.20 * F.least(F.lit(1.0), F.greatest(width, height) / target) + 0.30 * F.least(F.lit(1.0), sharpness / 250.0) + 0.20 * background
        + 0.20 * (1.0 - F.abs(fill - 0.80)) + 0.10 * F.least(F.lit(1.0), relevance / 40.0) - 0.20 * scoring.clamp(blockiness - 1.0)
    )
    score = F.when(gates, scoring.clamp(parts)).otherwise(0.0)
    return F.struct(F.round(score, 6).alias("score"), (gates & (score >= 0.35)).alias("approved"))


def quality_gates(width: Column, height: Column, sharpness: Column, mean: Column, bright: Column, burnt: Column, contrast: Column, blockiness: Column, min_side: int = 500, least_sharpness: float = 100.0) -> Column:
    """array<string>: the gates that an image fails, in their order. ``bright`` is the 90th percentile of the levels, ``burnt`` the share of white pixels, ``contrast`` the spread of the levels in 0..255."""
    aspect = width / F.nullif(height, F.lit(0))
    checks = (
        F.when((width < min_side) | (height < min_side), "too small"),
        F.when(~F.coalesce(aspect.between(0.4, 2.5), F.lit(False)), "aspect ratio"),
        F.when(sharpness < least_sharpness, "blurred"),
        F.when((mean < 35) | (bright < 64), "underexposed"),
        F.when((mean > 235) | (burnt > 0.20), "overexposed"),
        F.when(contrast / 255 < 0.15, "low contrast"),
        F.when(blockiness >= 2.5, "over-compressed"),
    )
    return F.filter(F.array(*checks), lambda x: x.isNotNull())
