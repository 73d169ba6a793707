"""String functions as column expressions: similarity, titles, sizes, identifiers, markup."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Eastern digits and what they are.
EASTERN_DIGITS, WESTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
#: Units as written, the unit they are measured in, and the factor.
WEIGHTS = {"g": 1.0, "gm": 1.0, "gms": 1.0, "grams": 1.0, "kg": 1000.0, "kgs": 1000.0, "kilograms": 1000.0}
WEIGHTS_AR = {"غرام": 1.0, "جرام": 1.0, "جم": 1.0, "كيلوغرام": 1000.0, "كجم": 1000.0, "كغم": 1000.0}
VOLUMES = {"ml": 1.0, "milliliters": 1.0, "l": 1000.0, "liters": 1000.0, "oz": 29.5735, "ounces": 1.0, r"fl\.?\s*oz": 29.5735}
VOLUMES_AR = {"مل": 1.0, "مليلتر": 1.0, "لتر": 1000.0}
#: Words of a bundle, and of a counted pack.
BUNDLE_WORDS = r"(?iU)\b(كرتونة|شدة|صندوق|مجموعة|باكيت|كرتون|علبة مجمعة|حزمة|pack|bundle|promo|multipack|box|tray|case)\b"
COUNTED_PACK = r"(?iU)(\d+)\s*(?:x|×|\*)\s*(\d+)?|(\d+)\s*(?:حبة|قطعة|وحدة|pcs|units|pack)"
#: Product codes by the first key that a name holds: key, brick, brick title, commodity, commodity title.
TAXONOMY = (
    ("milk", "10000025", "Milk and Milk Substitutes (Perishable)", "50131700", "Milk and butter and cream products"),
    ("chocolate", "10000043", "Confectionery Products", "50161813", "Chocolates and chocolate products"),
    ("hand wash", "10000350", "Personal Cleanliness / Hand Sanitizer", "53131608", "Hand handwash soap"),
    ("oil", "10000150", "Edible Plant Oils", "50151500", "Edible vegetable oils"),
)
TAXONOMY_DEFAULT = ("10000000", "General Groceries & CPG", "50000000", "Food Beverage and Tobacco Products")
#: Authority of domains, by suffix, and that of others.
DOMAIN_AUTHORITY = {"shopify.com": 96, "myshopify.com": 96, "cdn.shopify.com": 96, "magento.com": 90, "adobe.com": 97, "amazon.com": 96, "walmart.com": 92}
OTHER_AUTHORITY = 15
#: Rank multipliers of domains.
DOMAIN_WEIGHT = {"amazon.com": 1.5, "target.com": 1.4, "walmart.com": 1.4, "ebay.com": 1.1, "pinterest.com": 0.2, "istockphoto.com": 0.0}
#: Stock photo hosts.
STOCK_HOSTS = r"(?i)^https?://(?:[a-zA-Z0-9-]+\.)*(?:shutterstock|gettyimages|istockphoto|adobe|freepik|alamy|dreamstime|vectorstock|depositphotos|123rf)\.[a-z]{2,6}/.*"
#: Signs of a captcha page.
CAPTCHA_WORDS = ("captcha", "access denied", "cloudflare", "turnstile", "verify you are human", "security check")

#: What a clean title loses, and what takes its place, in this order.
TITLE_PATTERNS = (
    (r"\b\d{12,13}\b", ""),
    (r"\b(978|979)-\d{1,5}-\d{1,7}-\d{1,7}-\d{1}\b", ""),
    (r"\b\d+(\.\d+)?\s*(g|oz|ml|l|kg|ounces|grams|fluid\s*oz|fl\.?\s*oz)\b", ""),
    (r"\b(pack\s*of|pk\s*of|box\s*of|case\s*of|qty|x)\s*(\d+)\b", ""),
    (r"\b(\d+)\s*(count|ct|pcs|pack|pk)\b", ""),
    (r"(?U)[^\w\s\-\.\,\/]", " "),
    (r"\s+", " "),
)
#: Sizes and brackets that a search name loses.
SEARCH_SIZES = r"(?i)\b\d+(?:\.\d+)?\s*(?:ml|l|g|kg|pcs|pack|ltr|gm|oz|ozs|milliliter|liter|gram|kilogram|مل|لتر|جرام|جم|كجم|حبة)\b"
SEARCH_BRACKETS = r"\s*[\(\[].*?[\)\]]"
#: Sizes and counts of packs in a title.
SIZES = r"\b(\d+(?:\.\d+)?)\s*(ml|l|g|gm|kg|ltr|litre|grams|kilograms|لتر|مل|جرام|جم|كجم|كيلو|كيلوغرام)\b"
PACKS = r"\b(?:pack\s+of\s+|x\s*)(\d+)\b|\b(\d+)\s*(?:pcs|s|pack|packs|حبة|حبات|قطع|قطعة)\b"
LARGE_UNITS, LIQUID_UNITS = ("l", "ltr", "litre", "kg", "kilograms", "لتر", "كجم", "كيلو", "كيلوغرام"), ("ml", "l", "ltr", "litre", "مل", "لتر")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def levenshtein(a: Column, b: Column) -> Column:
    """Edit distance by code points; null is empty."""
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length of the trimmed lower-case strings, 1 for two empty ones; four digits."""
    x, y = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (a, b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.round(F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest), 4)


def jaro_winkler_value(a: str | None, b: str | None) -> float:
    """Jaro-Winkler with half transpositions kept as a fraction and no threshold for the prefix bonus."""
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    # the places of each character of b that are free, as bits: the first one within reach is the lowest
    free: dict[str, int] = {}
    for j, c in enumerate(b):
        free[c] = free.get(c, 0) | 1 << j
    taken, left, window = 0, [], (1 << 2 * reach + 1) - 1
    for i, c in enumerate(a):
        near = free.get(c, 0) & (window << i - reach if i >= reach else window >> reach - i)
        if near:
            bit = near & -near
            free[c] ^= bit
            taken |= bit
            left.append(c)
    m = len(left)
    if m == 0:
        return 0.0
    right = [c for j, c in enumerate(b) if taken >> j & 1]
    swapped = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return round(jaro + prefix * 0.1 * (1 - jaro), 4)


def jaro_winkler(a: Column, b: Column) -> Column:
    """``jaro_winkler_value`` over Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([jaro_winkler_value(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def compatible_form(c: Column) -> Column:
    """Unicode compatibility composition, which SQL has no function for."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return run(c)


def clean_title(c: Column, compose: bool = False) -> Column:
    """A title without marks, product codes, sizes and pack phrases; ``compose`` applies Unicode compatibility first."""
    t = F.coalesce(compatible_form(c) if compose else c, F.lit(""))
    t = F.trim(F.lower(F.translate(t, "®™©", "")))
    for pattern, by in TITLE_PATTERNS:
        t = F.regexp_replace(t, pattern, by)
    return F.trim(t)


def search_name(c: Column) -> Column:
    """A name without sizes and bracketed text."""
    t = F.regexp_replace(F.regexp_replace(c, SEARCH_SIZES, ""), SEARCH_BRACKETS, "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def fallback_query(c: Column) -> Column:
    """The cleaned name with the container that such a product comes in."""
    name, raw = search_name(c), F.lower(c)
    low = F.lower(name)
    small = reduce(lambda a, b: a | b, [raw.contains(x) for x in ("180ml", "200ml", "250ml")])
    suffix = (
        F.when(low.contains("milk"), F.when(low.contains("carton") | small, "carton").otherwise("bottle"))
        .when(low.contains("flour"), "bag")
        .when(low.contains("laban") | low.contains("kefir") | low.contains("yogurt"), "bottle")
        .otherwise("product")
    )
    return F.concat_ws(" ", name, suffix)


def normal_search(c: Column) -> Column:
    """Search text: lower case, digits apart from letters, no marks or punctuation, one form of alef, ta marbuta and ya."""
    t = F.lower(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, "([0-9]+)([a-zA-Z؀-ۿ])", "$1 $2")
    t = F.regexp_replace(t, "([a-zA-Z؀-ۿ])([0-9]+)", "$1 $2")
    t = F.regexp_replace(t, "[ً-ْ]", "")
    t = F.regexp_replace(t, r"(?U)[^\w\s]", "")
    return F.trim(F.translate(t, "إأآةى", "اااهي"))


def western_digits(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), EASTERN_DIGITS, WESTERN_DIGITS)


def metric(c: Column) -> Column:
    """struct(raw, value, unit) of the first weight, else volume, in g or ml; null without one."""
    t = western_digits(c)

    def found(units: dict[str, float], unit: str, latin: bool) -> Column:
        names = "|".join(sorted(units, key=lambda u: (-len(u), u)))
        pattern = rf"(?i)\b(\d+(?:\.\d+)?)\s*({names})\b" if latin else rf"(\d+(?:\.\d+)?)\s*({names})"
        raw, number, name = (F.regexp_extract(t, pattern, i) for i in (0, 1, 2))
        factor = F.when(F.lower(name).contains("oz"), 29.5735) if unit == "ml" else F.when(F.lit(False), 1.0)
        for u, by in units.items():
            if by == 1000.0:
                factor = factor.when(F.lower(name) == u, by)
        value = F.nullif(number, F.lit("")).cast("double")
        return F.when(raw != "", F.struct(raw.alias("raw"), (value * factor.otherwise(1.0)).alias("value"), F.lit(unit).alias("unit")))

    return F.coalesce(found(WEIGHTS, "g", True), found(WEIGHTS_AR, "g", False), found(VOLUMES, "ml", True), found(VOLUMES_AR, "ml", False))


def metric_match(a: Column, b: Column) -> Column:
    """1 within two per cent, 0 otherwise or for other units, 0.5 where one is missing. Two zeros match."""
    x, y = metric(a), metric(b)
    most = F.greatest(x["value"], y["value"])
    return (
        F.when(x.isNull() | y.isNull(), 0.5)
        .when(x["unit"] != y["unit"], 0.0)
        .when((most == 0) | (F.abs(x["value"] - y["value"]) <= 0.02 * most), 1.0)
        .otherwise(0.0)
    )


def sizes(c: Column) -> Column:
    """array<struct(value, unit)> of every size in the text, in ml or g; digits and word boundaries of any script."""
    whole = F.regexp_extract_all(western_digits(F.lower(c)), F.lit("(?U)" + SIZES), F.lit(0))

    def one(x: Column) -> Column:
        number = F.regexp_extract(x, r"^\d+(?:\.\d+)?", 0).cast("double")
        unit = F.regexp_extract(x, r"[^\d.\s]+$", 0)
        return F.struct((number * F.when(unit.isin(*LARGE_UNITS), 1000.0).otherwise(1.0)).alias("value"), F.when(unit.isin(*LIQUID_UNITS), "ml").otherwise("g").alias("unit"))

    return F.transform(whole, one)


def packs(c: Column) -> Column:
    """array<int> of every pack count in the text."""
    return F.transform(F.regexp_extract_all(western_digits(F.lower(c)), F.lit("(?U)" + PACKS), F.lit(0)), lambda x: F.regexp_extract(x, r"\d+", 0).cast("int"))


def volume_clash(target: Column, candidate: Column) -> Column:
    """Whether two titles name sizes of one unit more than 20 % apart, or first packs that differ."""
    ts, cs, tp, cp = sizes(target), sizes(candidate), packs(target), packs(candidate)
    apart = F.exists(ts, lambda t: F.exists(cs, lambda c: (t["unit"] == c["unit"]) & (F.least(t["value"], c["value"]) > 0) & (F.greatest(t["value"], c["value"]) > 1.2 * F.least(t["value"], c["value"]))))
    other = (F.size(tp) > 0) & (F.size(cp) > 0) & ~F.get(tp, F.lit(0)).eqNullSafe(F.get(cp, F.lit(0)))
    return (F.size(ts) > 0) & (apart | other)


def query_intent(c: Column) -> Column:
    """struct(intent, units): a bundle by its words or by a counted pack, with the count."""
    t = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    first, third = (F.nullif(F.regexp_extract(t, COUNTED_PACK, i), F.lit("")) for i in (1, 3))
    counted = F.coalesce(first, third)
    return F.struct(F.when(t.rlike(BUNDLE_WORDS) | counted.isNotNull(), "MULTI_PACK").otherwise("SINGLE_UNIT").alias("intent"), F.coalesce(counted.cast("int"), F.lit(1)).alias("units"))


def intent_score(intent: Column, units: Column, is_bundle: Column, unit_count: Column, aspect: Column) -> Column:
    multi, off = intent == "MULTI_PACK", F.abs(units - unit_count)
    bonus = F.when(multi, F.when(off == 0, 0.5).otherwise(F.greatest(F.lit(0.0), 0.3 - off * 0.05))).otherwise(0.0)
    shape = F.when(is_bundle & aspect.between(0.8, 1.3), 0.2).otherwise(0.0)
    return F.when(multi & ~is_bundle, 0.02).when(~multi & is_bundle, 0.05).otherwise(F.round(F.least(F.lit(2.0), 1.0 + bonus + shape), 2))


def gtin13_valid(c: Column) -> Column:
    """Whether a code has 13 digits and the right check digit."""
    digit = lambda i: F.substring(c, i + 1, 1).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), lambda acc, i: acc + F.substr(c, i + 1, F.lit(1)).cast("int") * (1 + 2 * (i % 2)))
    return F.coalesce(F.when(c.rlike(r"^[0-9]{13}$"), (10 - total % 10) % 10 == digit(12)), F.lit(False))


def gs1_link(c: Column) -> Column:
    """struct(gtin, batch, serial, gln, canonical) of a Digital Link; null fields where absent, all null without a GTIN."""
    t = F.trim(c)
    part = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    gtin = part(r"/01/(\d{14})")
    own = lambda x: F.when(gtin.isNotNull(), x)
    return F.struct(
        gtin.alias("gtin"),
        own(part(r"/10/([a-zA-Z0-9_-]+)")).alias("batch"),
        own(part(r"/21/([a-zA-Z0-9_-]+)")).alias("serial"),
        own(part(r"/(?:414|417)/(\d{13})")).alias("gln"),
        own(F.concat(F.lit("https://id.gs1.org/01/"), gtin)).alias("canonical"),
    )


def gs1_uri(domain: Column, gtin: Column, batch: Column, serial: Column) -> Column:
    base = F.concat(F.regexp_replace(domain, "/+$", ""), F.lit("/01/"), F.lpad(F.regexp_replace(gtin, r"\D", ""), 14, "0"))
    return F.concat(base, F.coalesce(F.concat(F.lit("/10/"), F.nullif(batch, F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit("/21/"), F.nullif(serial, F.lit(""))), F.lit("")))


def taxonomy(c: Column) -> Column:
    """struct(brick, brick_title, commodity, commodity_title, confidence) by the first key in the name."""
    low = F.lower(F.coalesce(c, F.lit("")))
    made = lambda row, confidence: F.struct(*[F.lit(v).alias(n) for n, v in zip(("brick", "brick_title", "commodity", "commodity_title"), row)], F.lit(confidence).alias("confidence"))
    out = F.when(F.lit(False), made(TAXONOMY_DEFAULT, 0.75))
    for key, *row in TAXONOMY:
        out = out.when(low.contains(key), made(row, 0.98))
    return out.otherwise(made(TAXONOMY_DEFAULT, 0.75))


def host(url: Column) -> Column:
    """Host of a URL in lower case, without www; empty without one."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))), r"^www\.", "")


def cdn_tier(url: Column) -> Column:
    return F.when(url.contains("cdn.shopify.com"), 1.0).when(url.contains("media/catalog/product"), 0.8).otherwise(0.3)


def merchant_authority(page_url: Column, image_url: Column, completeness: Column) -> Column:
    domain, score = host(page_url), F.when(F.lit(False), 0)
    for suffix, value in DOMAIN_AUTHORITY.items():
        score = score.when((domain == suffix) | domain.endswith("." + suffix), value)
    share = F.greatest(F.lit(0.1), F.least(F.lit(1.0), score.otherwise(OTHER_AUTHORITY) / 100))
    return F.round(0.4 * share + 0.4 * completeness + 0.2 * cdn_tier(image_url), 3)


def domain_weight(url: Column) -> Column:
    domain, out = F.lower(F.regexp_extract(url, r"https?://(?:www\.)?([^/]+)", 1)), F.when(F.lit(False), 1.0)
    for suffix, value in DOMAIN_WEIGHT.items():
        out = out.when(domain.endswith(suffix), value)
    return out.otherwise(1.0)


def json_ld(c: Column) -> Column:
    """struct(has_product, gtin, brand, currency, completeness) of a JSON-LD text: the object, or the first Product of an array."""
    kind = F.get_json_object(c, "$['@type']")
    items = F.from_json(c, "array<string>", {"mode": "PERMISSIVE"})
    first = F.get(F.filter(items, lambda x: F.get_json_object(x, "$['@type']") == "Product"), F.lit(0))
    doc = F.when(F.ltrim(c).startswith("["), first).when(kind == "Product", c)
    at = lambda path: F.nullif(F.get_json_object(doc, path), F.lit(""))
    gtin = F.coalesce(at("$.gtin"), at("$.gtin13"), at("$.gtin8"))
    brand = F.coalesce(at("$.brand.name"), F.when(~F.coalesce(at("$.brand"), F.lit("")).startswith("{"), at("$.brand")))
    currency = F.coalesce(at("$.offers.priceCurrency"), at("$.offers[0].priceCurrency"))
    found = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in (gtin, brand, currency, at("$.name"), at("$.image"))), F.lit(0))
    return F.struct(doc.isNotNull().alias("has_product"), gtin.alias("gtin"), brand.alias("brand"), currency.alias("currency"), F.when(doc.isNotNull(), F.round(found / 5, 2)).otherwise(0.0).alias("completeness"))


def pruned_html(c: Column) -> Column:
    """Markup without script, style and svg blocks and inline styles."""
    t = F.regexp_replace(c, r"(?is)<(script|style|svg)\b[^>]*>.*?</\1>", "")
    return F.regexp_replace(t, r"(?i)\sstyle=\"[^\"]*\"", "")


def looks_like_captcha(status: Column, html: Column) -> Column:
    """A page that was served but asks for a proof; an empty one isn't."""
    return F.coalesce((status == 200) & F.lower(html).rlike("|".join(CAPTCHA_WORDS)), F.lit(False))


#: Words of an error message by the category that it belongs to.
ERROR_WORDS = {
    "gemini": ("gemini", "vision", "model", "api key", "rate limit"),
    "photoroom": ("photoroom", "credit", "bg removal", "background", "removal"),
    "search": ("yandex", "bing", "search", "no results", "not found", "image"),
}
#: Signs of a log line's severity; the first that the line holds, case and all.
SEVERITY_SIGNS = {
    "error": ("❌", "Error", "failed"),
    "warning": ("⚠️", "warning"),
    "success": ("✅", "success", "تم بنجاح"),
    "system": ("⚙️", "System"),
}


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def error_categories(message: Column) -> Column:
    """array<string>: every category of which the message holds a word, or other. A message may be in more than one."""
    low = F.lower(F.coalesce(message, F.lit("")))
    found = F.filter(F.array(*[F.when(_holds(low, words), F.lit(name)) for name, words in ERROR_WORDS.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def log_severity(line: Column) -> Column:
    """The severity of a log line by its signs, or default."""
    c = F.coalesce(line, F.lit(""))
    return F.coalesce(*[F.when(_holds(c, signs), F.lit(name)) for name, signs in SEVERITY_SIGNS.items()], F.lit("default"))


#: Paths of categories by words of a title, and the path and confidence where none fits.
CATEGORY_WORDS = {
    "Fresh Food > Dairy & Eggs": ("milk", "egg", "eggs", "cheese", "yogurt", "butter"),
    "Beverages > Soft Drinks & Juices": ("juice", "soda", "drink", "cola", "pepsi", "fanta", "water"),
    "Health & Beauty > Skin Care & Soap": ("shampoo", "hair", "soap", "cream", "lotion", "skin"),
    "Household > Cleaning Supplies": ("clean", "detergent", "powder", "spray", "dish", "liquid"),
}
OTHER_CATEGORY = "Fresh Food > Vegetables & Fruits"


def lexical_category(title: Column) -> Column:
    """struct(path, confidence) by the first family with a word in the title."""
    low = F.lower(F.coalesce(title, F.lit("")))
    path = F.coalesce(*[F.when(_holds(low, words), F.lit(name)) for name, words in CATEGORY_WORDS.items()])
    return F.struct(F.coalesce(path, F.lit(OTHER_CATEGORY)).alias("path"), F.when(path.isNotNull(), 0.7).otherwise(0.4).alias("confidence"))


#: Brands that compete with one another.
KNOWN_BRANDS = ("lays", "doritos", "pringles", "zwan", "ajmi", "nestle", "al ain", "sadia", "almarai", "nivea", "dove")


def caption_agrees(caption: Column, brand: Column) -> Column:
    """False where a caption names a known brand and the product is of another known one; true for an empty caption or brand."""
    low, own = F.lower(F.coalesce(caption, F.lit(""))), F.lower(F.coalesce(brand, F.lit("")))
    rival = reduce(lambda a, b: a | b, [low.contains(w) & (own != w) for w in KNOWN_BRANDS])
    return ~((low != "") & own.isin(*KNOWN_BRANDS) & rival)


#: Brands that a package may name, and words of a variant without sugar in a title and on a package.
PACKAGE_BRANDS = ("cola", "pepsi", "nestle", "fanta", "sprite", "galaxy", "kinder", "zwan", "nellara", "alali")
SUGAR_IN_TITLE = ("zero", "diet", "no sugar")
SUGAR_ON_PACKAGE = ("zero", "diet", "no sugar", "light")


def variant_agrees(read: Column, title: Column, brand: Column) -> Column:
    """False where the words read from a package name another brand, or just one of package and title is without sugar; true where nothing was read."""
    low, own = F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lower(F.trim(F.coalesce(brand, F.lit(""))))
    rival = reduce(lambda a, b: a | b, [F.array_contains(read, w) & (own != w) & ~low.contains(w) for w in PACKAGE_BRANDS])
    package = F.arrays_overlap(read, F.array(*[F.lit(w) for w in SUGAR_ON_PACKAGE]))
    return F.when(F.coalesce(F.size(read), F.lit(0)) <= 0, True).otherwise(~rival & (package == _holds(low, SUGAR_IN_TITLE)))


def tagged(c: Column, tag: str) -> Column:
    """The trimmed text between a tag and its end; empty without one."""
    return F.trim(F.regexp_extract(c, rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def without_fences(c: Column) -> Column:
    """Text without the Markdown fences around it."""
    return F.trim(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", ""))


def row_hash(sku: Column, title: Column, price: Column, stock: Column) -> Column:
    return F.sha2(F.concat_ws("|", sku, title, F.format_string("%.4f", price.cast("double")), stock.cast("string")), 256)


def mime_by_magic(c: Column) -> Column:
    """MIME type by the first bytes of a binary; null for others."""
    head = F.hex(F.substring(c, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when((F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin("61766966", "61766973"), "image/avif")
    )


def image_dimensions(c: Column) -> Column:
    """struct(width, height) of a PNG or GIF header; nulls for others."""
    head = F.hex(F.substring(c, 1, 24))
    number = lambda s: F.conv(s, 16, 10).cast("int")
    little = lambda i: number(F.concat(F.substring(head, i + 2, 2), F.substring(head, i, 2)))
    mime = mime_by_magic(c)
    return F.struct(
        F.when(mime == "image/png", number(F.substring(head, 33, 8))).when(mime == "image/gif", little(13)).alias("width"),
        F.when(mime == "image/png", number(F.substring(head, 41, 8))).when(mime == "image/gif", little(17)).alias("height"),
    )


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def hamming_hex(a: Column, b: Column) -> Column:
    """Bits that differ between two 16-digit hexadecimal hashes; 64 if one isn't."""
    part = lambda c, i: F.conv(F.substring(c, i, 8), 16, 10).cast("bigint")
    bits = F.bit_count(part(a, 1).bitwiseXOR(part(b, 1))) + F.bit_count(part(a, 9).bitwiseXOR(part(b, 9)))
    proper = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    return F.when(proper, bits).otherwise(64)
