"""Scores, prices and colours as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least third-stage margin in per cent, by category.
MARGIN_TARGETS = {"beauty_wellness": 50.0, "home_kitchen": 30.0, "consumer_electronics": 15.0, "grocery": 10.0, "pet_supplies": 35.0}
OTHER_MARGIN_TARGET = 20.0
#: Chances of agreement among matches and among others, by feature.
LINKAGE = {"gtin": (0.99, 0.0001), "brand": (0.95, 0.02), "product_name": (0.90, 0.01), "weight_volume": (0.92, 0.05), "category": (0.88, 0.10)}
OTHER_LINKAGE = (0.90, 0.05)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def atwater(protein: Column, carbs: Column, fiber: Column, fat: Column, alcohol: Column) -> Column:
    p, c, f, t, a = (F.greatest(F.lit(0.0), x) for x in (protein, carbs, fiber, fat, alcohol))
    return F.round(4 * p + 4 * F.greatest(F.lit(0.0), c - f) + 9 * t + 2 * f + 7 * a, 2)


def nutrition_check(calories: Column, protein: Column, carbs: Column, fiber: Column, fat: Column, alcohol: Column, serving: Column, unit: Column) -> Column:
    """struct(valid, estimated, deviation, mass_ok)."""
    estimated = atwater(protein, carbs, fiber, fat, alcohol)
    deviation = F.when(calories > 0, F.abs(calories - estimated) / calories * 100).when(estimated == 0, 0.0).otherwise(100.0)
    mass_ok = ~((F.lower(unit) == "g") & (serving > 0) & (protein + carbs + fat + alcohol > serving * 1.02))
    return F.struct(((deviation <= 5) & mass_ok).alias("valid"), estimated.alias("estimated"), F.round(deviation, 2).alias("deviation"), mass_ok.alias("mass_ok"))


def nutri_score(calories: Column, sugar: Column, saturated: Column, protein: Column, fiber: Column) -> Column:
    step = lambda c, high, low, a, b: F.when(c > high, a).when(c > low, b).otherwise(0)
    points = step(calories, 335, 167, 4, 2) + step(sugar, 13.5, 4.5, 4, 2) + step(saturated, 4.0, 1.0, 4, 2) - step(protein, 4.8, 1.6, 3, 1) - step(fiber, 3.5, 0.9, 3, 1)
    return F.when(points <= -1, "A").when(points <= 2, "B").when(points <= 10, "C").when(points <= 18, "D").otherwise("E")


def landed_cost(base: Column, coupon: Column, tier: Column, shipping: Column) -> Column:
    return F.greatest(F.lit(0.01), F.round(base - coupon - tier + shipping, 2))


def defend_price(quantity: Column) -> Column:
    return quantity <= 2


def margins(revenue: Column, first: list[Column], second: list[Column], third: list[Column], category: Column) -> Column:
    """struct(cm1, cm1_pct, cm2, cm2_pct, cm3, cm3_pct, healthy): revenue less the costs of each stage; zeros without revenue."""
    one = reduce(lambda a, b: a - b, first, revenue)
    two = one - reduce(lambda a, b: a + b, second)
    three = two - reduce(lambda a, b: a + b, third)
    some = revenue > 0
    target = F.when(F.lit(False), OTHER_MARGIN_TARGET)
    for name, least in MARGIN_TARGETS.items():
        target = target.when(F.lower(category) == name, least)
    fields = []
    for name, value in (("cm1", one), ("cm2", two), ("cm3", three)):
        fields += [F.when(some, F.round(value, 2)).otherwise(0.0).alias(name), F.when(some, F.round(value / revenue * 100, 2)).otherwise(0.0).alias(f"{name}_pct")]
    return F.struct(*fields, F.coalesce(some & (three / revenue * 100 >= target.otherwise(OTHER_MARGIN_TARGET)), F.lit(False)).alias("healthy"))


def package_drift(similarity: Column, allergen: Column, ingredients: Column, certification: Column) -> Column:
    """struct(has_drift, drift, risk, rollback): critical labels before certificates before looks."""
    drift = clamp(1 - similarity)
    risk = F.when(allergen | ingredients, "IMMEDIATE_ESCALATION").when(certification, "TECHNICAL_REVIEW_HOLD").when(drift >= 0.15, "SCHEDULED_QUEUE").otherwise("NO_DRIFT")
    return F.struct((risk != "NO_DRIFT").alias("has_drift"), F.round(drift, 4).alias("drift"), risk.alias("risk"), (risk == "IMMEDIATE_ESCALATION").alias("rollback"))


def ocr_score(brand: Column, category: Column, metric: Column, nothing_read: Column) -> Column:
    return F.when(nothing_read, 0.85).otherwise(clamp(0.5 * brand + 0.3 * category + 0.2 * metric))


def fusion(visual: Column, ocr: Column, judge: Column) -> Column:
    return F.round((0.4 * clamp(visual) + 0.6 * clamp(ocr)) * clamp(judge), 4)


def fusion_decision(score: Column) -> Column:
    return F.when(score >= 0.88, "AUTO_APPROVE").when(score >= 0.65, "MANUAL_REVIEW").otherwise("AUTO_REJECT")


def linkage_weight(feature: str, agrees: Column) -> Column:
    m, u = LINKAGE.get(feature, OTHER_LINKAGE)
    return F.when(agrees, round(math.log2(m / u), 4)).otherwise(round(math.log2((1 - m) / (1 - u)), 4))


def linkage_decision(weight: Column) -> Column:
    return F.when(weight >= 8, "GOLD_MATCH").when(weight >= 4, "PROBABLE_MATCH").when(weight >= 1, "NEEDS_REVIEW").otherwise("DECLINED")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes array(x, y, width, height); 0 without area."""
    at = lambda box, i: F.element_at(box, i + 1)
    side = lambda i: F.greatest(F.lit(0), F.least(at(a, i) + at(a, i + 2), at(b, i) + at(b, i + 2)) - F.greatest(at(a, i), at(b, i)))
    shared = side(0) * side(1)
    union = at(a, 2) * at(a, 3) + at(b, 2) * at(b, 3) - shared
    return F.round(F.when(union > 0, shared / union).otherwise(0.0), 4)


def arcface_loss(cosine: Column, scale: float = 30.0, margin: float = 0.5) -> Column:
    """Loss of the target class against one other of the complementary cosine."""
    c = clamp(cosine, -1 + 1e-7, 1 - 1e-7)
    target = scale * F.cos(F.acos(c) + margin)
    return F.round(-F.ln(F.exp(target) / (F.exp(target) + F.exp(scale * (1 - c)))), 4)


def volume_grounding(length: Column, width: Column, height: Column, catalog: Column) -> Column:
    """struct(measured, gamma, kind, eta)."""
    box = length * width * height
    measured = box * 0.88
    gamma = measured / (catalog + 1e-8)
    return F.struct(F.round(measured, 2).alias("measured"), F.round(gamma, 3).alias("gamma"), F.when(gamma > 1.3, "MULTI_PACK").otherwise("SINGLE_UNIT").alias("kind"), F.round(measured / (box + 1e-8), 3).alias("eta"))


def back_projection(u: Column, v: Column, depth: Column, focal: float = 525.0) -> Column:
    return F.struct(F.round((u - 320) * depth / focal, 2).alias("x"), F.round((v - 240) * depth / focal, 2).alias("y"), F.round(depth, 2).alias("z"))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) of an sRGB colour (0-255) under D65, three digits."""
    linear = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    root = lambda t: let(t, lambda v: F.when(v > 0.008856, F.pow(v, F.lit(1 / 3))).otherwise(7.787 * v + 16 / 116))

    def axes(c: Column) -> Column:
        mixed = lambda x, y, z, white: root((c["r"] * x + c["g"] * y + c["b"] * z) / white)
        return F.struct(mixed(0.4124564, 0.3575761, 0.1804375, 0.95047).alias("x"), mixed(0.2126729, 0.7151522, 0.0721750, 1.0).alias("y"), mixed(0.0193339, 0.1191920, 0.9503041, 1.08883).alias("z"))

    opponent = lambda c: F.struct(F.round(F.greatest(F.lit(0.0), 116 * c["y"] - 16), 3).alias("l"), F.round(500 * (c["x"] - c["y"]), 3).alias("a"), F.round(200 * (c["y"] - c["z"]), 3).alias("b"))
    return let(let(F.struct(linear(r).alias("r"), linear(g).alias("g"), linear(b).alias("b")), axes), opponent)


def ciede2000(p: Column, q: Column) -> Column:
    """Colour difference of two struct(l, a, b), four digits."""
    sq = lambda c: c * c
    seventh = lambda c: F.sqrt(F.pow(c, F.lit(7.0)) / (F.pow(c, F.lit(7.0)) + 25.0**7))
    hue = lambda a, b: F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))
    cosine = lambda c: F.cos(F.radians(c))

    def stretched(x: Column) -> Column:
        g = 1.5 - 0.5 * seventh((F.hypot(x["p"]["a"], x["p"]["b"]) + F.hypot(x["q"]["a"], x["q"]["b"])) / 2)
        return F.struct(x["p"].alias("p"), x["q"].alias("q"), (g * x["p"]["a"]).alias("ap"), (g * x["q"]["a"]).alias("aq"))

    def polar(x: Column) -> Column:
        chroma = lambda side: F.hypot(x[f"a{side}"], x[side]["b"]).alias(f"c{side}")
        angle = lambda side: hue(x[f"a{side}"], x[side]["b"]).alias(f"h{side}")
        return F.struct((x["q"]["l"] - x["p"]["l"]).alias("dl"), ((x["p"]["l"] + x["q"]["l"]) / 2).alias("ml"), chroma("p"), chroma("q"), angle("p"), angle("q"))

    def differences(x: Column) -> Column:
        grey, far, turn, both = x["cp"] * x["cq"] == 0, F.abs(x["hp"] - x["hq"]) > 180, x["hq"] - x["hp"], x["hp"] + x["hq"]
        dh = F.when(grey, 0.0).when(~far, turn).when(turn > 180, turn - 360).otherwise(turn + 360)
        mh = F.when(grey, both).when(~far, both / 2).when(both < 360, (both + 360) / 2).otherwise((both - 360) / 2)
        return F.struct(x["dl"].alias("dl"), x["ml"].alias("ml"), (x["cq"] - x["cp"]).alias("dc"), ((x["cp"] + x["cq"]) / 2).alias("mc"), (2 * F.sqrt(x["cp"] * x["cq"]) * F.sin(F.radians(dh / 2))).alias("dh"), mh.alias("mh"))

    def weighted(x: Column) -> Column:
        t = 1 - 0.17 * cosine(x["mh"] - 30) + 0.24 * cosine(2 * x["mh"]) + 0.32 * cosine(3 * x["mh"] + 6) - 0.20 * cosine(4 * x["mh"] - 63)
        off = sq(x["ml"] - 50)
        turn = F.sin(F.radians(60 * F.exp(-sq((x["mh"] - 275) / 25)))) * 2 * seventh(x["mc"])
        return F.struct((x["dl"] / (1 + 0.015 * off / F.sqrt(20 + off))).alias("l"), (x["dc"] / (1 + 0.045 * x["mc"])).alias("c"), (x["dh"] / (1 + 0.015 * x["mc"] * t)).alias("h"), turn.alias("turn"))

    total = lambda x: F.round(F.sqrt(F.greatest(F.lit(0.0), sq(x["l"]) + sq(x["c"]) + sq(x["h"]) - x["turn"] * x["c"] * x["h"])), 4)
    steps = lambda x: let(let(let(let(stretched(x), polar), differences), weighted), total)
    return let(F.struct(p.alias("p"), q.alias("q")), steps)


def purity(loss: Column) -> Column:
    return F.round(100 * (1 - loss), 2)


def importance(rows: Column, most: Column, columns: Column, streams: Column, shared: Column) -> Column:
    top = F.when(most > 0, most).otherwise(F.greatest(F.lit(1), rows))
    return F.round(200 * (rows / top) * columns * 0.1 + streams * 7 + shared * 3, 2)


def uncertainty(p: Column) -> Column:
    """struct(least_confidence, margin, entropy, priority) of class probabilities."""
    down = F.sort_array(p, asc=False)
    least = 1 - F.element_at(down, 1)
    margin = F.when(F.size(p) < 2, 0.0).otherwise(1 - (F.element_at(down, 1) - F.get(down, F.lit(1))))
    entropy = -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.when(x > 1e-12, x * F.ln(x)).otherwise(0.0))
    return F.struct(least.alias("least_confidence"), margin.alias("margin"), entropy.alias("entropy"), F.round(0.4 * least + 0.4 * margin + 0.2 * entropy, 4).alias("priority"))


def nima(p: Column) -> Column:
    """Expected score of ten bins; 5.5 for another number of bins or no weight."""
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.aggregate(F.transform(p, lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(p) == 10) & (total > 0), F.round(mean / total, 2)).otherwise(5.5)


def sigmoid_probability(features: list[Column], means: list[float], scales: list[float], weights: list[float], bias: float) -> Column:
    z = reduce(lambda a, b: a + b, [(x - m) / s * w for x, m, s, w in zip(features, means, scales, weights, strict=True)]) + bias
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def composite_score(aesthetic: Column, brenner: Column, resolution: Column, purity_fill: Column) -> Column:
    return F.round(0.4 * clamp((aesthetic - 1) / 9) + 0.2 * clamp(F.log10(1 + brenner) / 4) + 0.2 * clamp(resolution / 3840) + 0.2 * clamp(purity_fill), 4)


def size_gate(width: Column, height: Column) -> Column:
    """struct(ok, reason): both sides at least 300 and a ratio from 0.5 to 2."""
    ratio = width / F.nullif(height, F.lit(0))
    small = (width < 300) | (height < 300)
    ok = ~small & ratio.between(0.5, 2.0)
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.when(small, "TOO_SMALL").when(~ratio.between(0.5, 2.0), "BAD_ASPECT").otherwise("OK").alias("reason"))


def resolution_gate(width: Column, height: Column) -> Column:
    """struct(passed, score, reasons): longest side at least 1000, ratio from 0.8 to 1.25."""
    most, ratio = F.greatest(width, height), width / F.nullif(height, F.lit(0))
    reasons = F.filter(F.array(F.when(most < 1000, "low resolution"), F.when(~F.coalesce(ratio.between(0.8, 1.25), F.lit(False)), "aspect ratio")), lambda x: x.isNotNull())
    passed = F.size(reasons) == 0
    return F.struct(passed.alias("passed"), F.when(passed, F.round(F.least(F.lit(1.0), most / 1600), 4)).otherwise(0.0).alias("score"), F.array_join(reasons, " | ").alias("reasons"))
