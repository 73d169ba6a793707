"""Measures of decoded images: numpy on raw pixel arrays, in Arrow batches.

An image is (height, width, channels, pixels) with row-major bytes, as a decoder
would give it. ``decoded`` reads PNG files of eight bits a channel; for other kinds
decoding is left to the reader.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixels(height: int, width: int, channels: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)


def png_pixels(raw: bytes | None) -> tuple[int, int, int, bytes] | None:
    """(height, width, channels, pixels) of a PNG of eight bits a channel, without interlace or palette; None for others and for broken files."""
    if not raw or raw[:8] != b"\x89PNG\r\n\x1a\n" or raw[12:16] != b"IHDR":
        return None
    width, height = int.from_bytes(raw[16:20], "big"), int.from_bytes(raw[20:24], "big")
    depth, kind, interlace = raw[24], raw[25], raw[28]
    n = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind, 0)
    if depth != 8 or interlace or not n or not width or not height:
        return None
    at, packed = 8, []
    while at + 8 <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        if raw[at + 4 : at + 8] == b"IDAT":
            packed.append(raw[at + 8 : at + 8 + size])
        at += 12 + size
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    except (zlib.error, ValueError):
        return None
    out = np.zeros((height + 1, width + 1, n), np.int64)  # a row and a column of zeros before the first
    for y in range(height):
        line, row, up = lines[y, 1:].reshape(width, n).astype(np.int64), out[y + 1], out[y]
        if lines[y, 0] == 0:
            row[1:] = line
        elif lines[y, 0] == 1:
            row[1:] = np.cumsum(line, axis=0) % 256
        elif lines[y, 0] == 2:
            row[1:] = (line + up[1:]) % 256
        elif lines[y, 0] == 3:
            for x in range(width):
                row[x + 1] = (line[x] + (row[x] + up[x + 1]) // 2) % 256
        elif lines[y, 0] == 4:
            for x in range(width):
                a, b, c = row[x], up[x + 1], up[x]
                near = np.abs(np.stack([b - c, a - c, a + b - 2 * c])).argmin(axis=0)  # the first of equals
                row[x + 1] = (line[x] + np.choose(near, [a, b, c])) % 256
        else:
            return None
    pixels_of = out[1:, 1:].astype(np.uint8)
    if kind == 4:  # grey with transparency
        pixels_of = pixels_of[..., :1]
    return height, width, pixels_of.shape[2], pixels_of.tobytes()


def decoded(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, height, width, channels, pixels) of PNG files in a binary column; nulls for what can't be read."""
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 50):
                part = batch.slice(low, 50)
                rows = [png_pixels(c) or (None,) * 4 for c in part.column(content).to_pylist()]
                made = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(key), *made], names=[key, "height", "width", "channels", "pixels"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInArrow(run, f"`{key}` {kind}, height int, width int, channels int, pixels binary")


def grey(image: np.ndarray) -> np.ndarray:
    return image[..., 0] if image.shape[2] == 1 else image[..., :3] @ np.array([0.299, 0.587, 0.114])


def _inside(g: np.ndarray, dy: int, dx: int) -> np.ndarray:
    return g[1 + dy : g.shape[0] - 1 + dy, 1 + dx : g.shape[1] - 1 + dx]


def laplacian_variance(image: np.ndarray) -> float:
    """Sharpness: variance of the four-neighbour Laplacian."""
    g = grey(image)
    return float((_inside(g, -1, 0) + _inside(g, 1, 0) + _inside(g, 0, -1) + _inside(g, 0, 1) - 4 * _inside(g, 0, 0)).var())


def tenengrad(image: np.ndarray) -> float:
    """Mean squared Sobel gradient."""
    g = grey(image)
    at = lambda dy, dx: _inside(g, dy, dx)
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    return float((gx**2 + gy**2).mean())


def brenner(image: np.ndarray) -> float:
    g = grey(image)
    return float(((g[2:] - g[:-2]) ** 2).mean())


def colour_entropy(image: np.ndarray) -> float:
    """Entropy in bits of a histogram of 16 levels a channel."""
    q = (image[..., :3] // 16).astype(np.int64)
    n = np.bincount((q[..., 0] * 256 + q[..., 1] * 16 + q[..., 2]).ravel())
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum())


def cavi(image: np.ndarray, clean: float = 1.0) -> float:
    """Aesthetic index in 0..10 of sharpness, colour entropy and cleanness."""
    return float(np.clip((0.4 * math.log(laplacian_variance(image) + 1) + 0.35 * colour_entropy(image) / 12 + 0.25 * clean + 2) * 1.25, 0, 10))


def colourfulness(image: np.ndarray) -> float:
    """Spread and mean of the opponent channels."""
    r, g, b = image[..., 0], image[..., 1], image[..., 2]
    rg, yb = r - g, 0.5 * (r + g) - b
    return round(float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())), 2)


def watermark_energy(image: np.ndarray) -> float:
    """Mean absolute eight-neighbour Laplacian over the white background; 0 without one."""
    g = grey(image)
    high = np.abs(8 * _inside(g, 0, 0) - sum(_inside(g, y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y, x) != (0, 0)))
    back = _inside(g, 0, 0) > 240
    return float(high[back].mean()) if back.any() else 0.0


def white_border(image: np.ndarray, width: int = 3, tolerance: int = 10) -> float:
    """Share of the border's pixels that are white."""
    white = (image[..., :3] >= 255 - tolerance).all(axis=2)
    edge = np.ones_like(white)
    edge[width:-width, width:-width] = False
    return float(white[edge].mean())


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits of the low frequencies of a 32 x 32 cosine transform against their mean without the constant one, as a signed number."""
    g = grey(image)
    rows = np.linspace(0, g.shape[0], 33).astype(int)
    cols = np.linspace(0, g.shape[1], 33).astype(int)
    small = np.array([[g[rows[i] : max(rows[i + 1], rows[i] + 1), cols[j] : max(cols[j + 1], cols[j] + 1)].mean() for j in range(32)] for i in range(32)])
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ small @ basis.T)[:8, :8].ravel()
    bits = low > low[1:].mean()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def hull_ratio(mask: np.ndarray) -> float:
    """Area of the convex hull of a mask over that of its bounding box; 0 for fewer than three points."""
    ys, xs = np.nonzero(mask)
    points = sorted(set(zip(xs.tolist(), ys.tolist(), strict=True)))
    if len(points) < 3:
        return 0.0

    def half(ps: list) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(points) + half(points[::-1])
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1], strict=True))) / 2
    box = (xs.max() - xs.min() + 1) * (ys.max() - ys.min() + 1)
    return round(float(area / box), 4)


def packaging_ratio(image: np.ndarray) -> float:
    """``hull_ratio`` of what is darker than the background; 0 for fewer than ten such pixels."""
    dark = grey(image) < 240
    return hull_ratio(dark) if dark.sum() >= 10 else 0.0


def shadow(image: np.ndarray) -> float:
    """1 where soft grey covers more than a twenty-fifth of what is darker than the background."""
    g = grey(image)
    return float(((g >= 160) & (g < 235)).sum() > 0.04 * (g < 240).sum())


def mean_level(image: np.ndarray) -> float:
    return float(grey(image).mean())


def bright_level(image: np.ndarray) -> float:
    return float(np.percentile(grey(image), 90))


def burnt_share(image: np.ndarray) -> float:
    """Share of pixels at the top of the range."""
    return float((grey(image) >= 254).mean())


def fill_ratio(image: np.ndarray, white: int = 251) -> float:
    """Area of the bounding box of what isn't white over that of the image."""
    ys, xs = np.nonzero((image[..., :3] < white).any(axis=2))
    return float((xs.max() - xs.min() + 1) * (ys.max() - ys.min() + 1) / image[..., 0].size) if len(ys) else 0.0


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column after the last) of each run of a mask, row by row."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    steps = np.diff(padded, axis=1)
    rows, starts = np.nonzero(steps == 1)
    return rows, starts, np.nonzero(steps == -1)[1]


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """(labels from 1 in the order of their first pixels, their number): pixels of a mask that touch, at corners too if ``diagonal``.

    Runs of a row get a label each, runs that touch one of the row above join its set
    (union-find), and a second pass writes the sets' labels: work grows with the runs.
    """
    rows, starts, ends = _runs(mask)
    parent, reach = list(range(len(rows))), int(diagonal)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1)).tolist()
    a, b = starts.tolist(), ends.tolist()
    for row in range(1, mask.shape[0]):
        above, here = first[row - 1], first[row]
        while above < first[row] and here < first[row + 1]:
            if a[here] < b[above] + reach and a[above] < b[here] + reach:
                low, high = sorted((find(above), find(here)))
                parent[high] = low
            if b[above] < b[here]:
                above += 1
            else:
                here += 1
    roots = np.array([find(i) for i in range(len(parent))], dtype=np.int64)
    kept, labels = np.unique(roots, return_inverse=True)
    out = np.zeros(mask.shape, np.int32)
    for row, low, high, label in zip(rows.tolist(), a, b, labels.tolist(), strict=True):
        out[row, low:high] = label + 1
    return out, len(kept)


def filled(mask: np.ndarray) -> np.ndarray:
    """A mask with its holes: all but what is open to the outside, through sides and not through corners."""
    around = np.pad(~mask, 1, constant_values=True)
    labels, _ = components(around, diagonal=False)
    return ~(labels == labels[0, 0])[1:-1, 1:-1]


def objects(mask: np.ndarray) -> list[tuple[int, int, int, int, int, float]]:
    """(x, y, width, height, pixels, contour area) of each outermost object of a mask, holes included, in the order of first pixels.

    The contour goes through the centres of the border's pixels, so its area is that
    of the squares between four pixels, and half of that between three.
    """
    labels, n = components(filled(mask))
    rows, starts, ends = _runs(labels > 0)
    of = labels[rows, starts] - 1
    low_x, high_x = np.full(n, mask.shape[1]), np.zeros(n, np.int64)
    low_y, high_y = np.full(n, mask.shape[0]), np.zeros(n, np.int64)
    np.minimum.at(low_x, of, starts)
    np.maximum.at(high_x, of, ends)
    np.minimum.at(low_y, of, rows)
    np.maximum.at(high_y, of, rows + 1)
    pixels = np.bincount(of, ends - starts, n)
    corners = [labels[:-1, :-1], labels[:-1, 1:], labels[1:, :-1], labels[1:, 1:]]
    held, owner = sum((c > 0).astype(int) for c in corners), np.maximum.reduce(corners)
    area = np.bincount(owner[held >= 3] - 1, np.where(held[held >= 3] == 4, 1.0, 0.5), n) if n else np.zeros(0)
    return [tuple(x) for x in zip(low_x.tolist(), low_y.tolist(), (high_x - low_x).tolist(), (high_y - low_y).tolist(), pixels.astype(int).tolist(), area.tolist(), strict=True)]


def largest(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x, y, width, height) of the object of largest contour area, the first of equal ones; None for an empty mask."""
    found = objects(mask)
    return max(found, key=lambda o: o[5])[:4] if found else None


def _box_share(box: tuple[int, int, int, int] | None, mask: np.ndarray) -> float:
    return box[2] * box[3] / mask.size if box else 0.0


def border(pixels: np.ndarray, width: int) -> np.ndarray:
    """The full rows at the top and bottom and the full columns at the sides, so corners come twice."""
    flat = (-1, *pixels.shape[2:])
    return np.concatenate([pixels[:width].reshape(flat), pixels[-width:].reshape(flat), pixels[:, :width].reshape(flat), pixels[:, -width:].reshape(flat)])


#: White-background gates: border in pixels, least white level, least share of white, least fill, least side.
BACKGROUND_GATES = {
    "strict": (10, 251, 0.98, 0.85, 21),
    "perimeter": (6, 250, 0.995, 0.0, 1),
    "original": (1, 248, 0.96, 0.0, 400),
    "compliance": (1, 253, None, None, 1),
}


def background_gate(name: str, image: np.ndarray) -> tuple[float, float, bool | None]:
    """(share of white in the border, fill, passed) by a gate; an image that is too small for it fails.

    ``strict`` and ``original`` count the corners of the border twice, ``perimeter``
    once. ``compliance`` counts channels, takes as fill the box of the largest object
    darker than its level in grey, and has no verdict; the others count pixels and
    take the box of all that isn't white.
    """
    width, level, least_white, least_fill, side = BACKGROUND_GATES[name]
    if min(image.shape[:2]) < side:
        return 0.0, 0.0, False
    if name == "compliance":
        dark = grey(image) > level
        if dark.all():
            return 0.0, 0.0, None
        return float((border(image[..., :3], width) >= level).mean()), _box_share(largest(~dark), dark), None
    white = (image[..., :3] >= level).all(axis=2)
    if name == "perimeter":
        edge = np.ones(white.shape, dtype=bool)
        edge[width:-width, width:-width] = False
        purity = float(white[edge].mean())
    else:
        purity = float(border(white, width).mean())
    fill = fill_ratio(image, level)
    return purity, fill, purity >= least_white and fill >= least_fill


def layout(image: np.ndarray, level: int = 248) -> tuple[float, float, bool]:
    """(fill, offset, centred): the box of all objects up to a grey level, and how far the centre of their pixels is from the middle, as a share of the side; at most a tenth either way is centred."""
    mask = grey(image) <= level
    if not mask.any():
        return 0.0, 1.0, False
    ys, xs = np.nonzero(mask)
    h, w = mask.shape
    fill = (xs.max() + 1 - xs.min()) * (ys.max() + 1 - ys.min()) / mask.size
    off_x, off_y = abs(xs.mean() - w / 2) / w, abs(ys.mean() - h / 2) / h
    return float(fill), float(max(off_x, off_y)), bool(off_x <= 0.1 and off_y <= 0.1)


def largest_fill(image: np.ndarray, level: int = 248) -> float:
    """Share of the image that the box of its largest object up to a grey level takes."""
    mask = grey(image) <= level
    return _box_share(largest(mask), mask)


def frequency_ratio(image: np.ndarray) -> float:
    """Share of the spectrum's magnitude outside the low quarter."""
    f = np.abs(np.fft.fftshift(np.fft.fft2(grey(image))))
    h, w = f.shape
    low = f[h // 2 - h // 8 : h // 2 + h // 8 + 1, w // 2 - w // 8 : w // 2 + w // 8 + 1].sum()
    return float(1 - low / f.sum()) if f.sum() else 0.0


def exposure(image: np.ndarray) -> float:
    """Median level."""
    return float(np.percentile(grey(image), 50))


def contrast(image: np.ndarray) -> float:
    """Distance of the 99th from the first percentile."""
    g = grey(image)
    return float(np.percentile(g, 99) - np.percentile(g, 1))


def blockiness(image: np.ndarray) -> float:
    """Steps at the borders of 8 x 8 blocks against steps elsewhere; 1 for none."""
    g = grey(image)
    d = np.abs(np.diff(g, axis=1))
    at = np.arange(d.shape[1]) % 8 == 7
    inside = d[:, ~at].mean() if (~at).any() else 0.0
    return float(d[:, at].mean() / inside) if at.any() and inside else 1.0


def centring(image: np.ndarray) -> float:
    """1 less the distance of the dark mass's centre from the middle, as a share of half the diagonal."""
    dark = 255 - grey(image)
    total = dark.sum()
    if not total:
        return 0.0
    h, w = dark.shape
    y, x = (dark.sum(axis=1) @ np.arange(h)) / total, (dark.sum(axis=0) @ np.arange(w)) / total
    return float(1 - np.hypot(y - (h - 1) / 2, x - (w - 1) / 2) / (np.hypot(h, w) / 2))


def has_content(image: np.ndarray) -> float:
    """0 for a nearly flat image: mean deviation of the channels under 12 and at most two hue peaks."""
    flat = image[..., :3].std(axis=(0, 1)).mean() < 12
    r, g, b = (image[..., i].ravel() for i in range(3))
    hue = np.degrees(np.arctan2(math.sqrt(3) * (g - b), 2 * r - g - b)) % 360
    n = np.bincount((hue // 30).astype(int), minlength=12)
    peaks = int((n > 0.05 * n.sum()).sum())
    return 0.0 if flat and peaks <= 2 else 1.0


def naturalness(image: np.ndarray) -> float:
    """100 less the deviation of the levels, in 0..100."""
    return float(np.clip(100 - grey(image).std(), 0, 100))


def aesthetic(image: np.ndarray) -> float:
    """A heuristic grade in 1..10 of saturation and deviation, lower at extreme brightness."""
    top, low = image[..., :3].max(axis=2), image[..., :3].min(axis=2)
    saturation = np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0).mean()
    extreme = not 40 <= top.mean() <= 220
    return float(np.clip(5 + saturation / 50 + top.std() / 30 - 2 * extreme, 1, 10))


def projection_variance(image: np.ndarray) -> float:
    """Mean variance of the row and column sums, scaled by the size."""
    g = grey(image) / 255
    return float((g.mean(axis=0).var() + g.mean(axis=1).var()) / 2)


#: Gate measures by column name.
GATES = {
    "frequency_ratio": frequency_ratio,
    "exposure": exposure,
    "contrast": contrast,
    "blockiness": blockiness,
    "centring": centring,
    "content": has_content,
    "naturalness": naturalness,
    "aesthetic": aesthetic,
    "projection": projection_variance,
}

#: What the audits of a catalog need, by column name.
AUDIT = {
    "sharpness": laplacian_variance,
    "colourfulness": colourfulness,
    "packaging": packaging_ratio,
    "shadow": shadow,
    "mean_level": mean_level,
    "bright_level": bright_level,
    "burnt_share": burnt_share,
    "contrast": contrast,
    "blockiness": blockiness,
    "fill": fill_ratio,
    "content": has_content,
    "n_objects": lambda image: float(len(objects(grey(image) <= 248))),
    "largest_fill": largest_fill,
    "layout_fill": lambda image: layout(image)[0],
    "layout_offset": lambda image: layout(image)[1],
    "layout_centred": lambda image: float(layout(image)[2]),
    **{f"{name}_purity": (lambda image, name=name: background_gate(name, image)[0]) for name in BACKGROUND_GATES},
    **{f"{name}_fill": (lambda image, name=name: background_gate(name, image)[1]) for name in BACKGROUND_GATES},
    **{f"{name}_passed": (lambda image, name=name: float(background_gate(name, image)[2])) for name in BACKGROUND_GATES if name != "compliance"},
}

#: Measures by column name.
MEASURES = {
    "sharpness": laplacian_variance,
    "tenengrad": tenengrad,
    "brenner": brenner,
    "colour_entropy": colour_entropy,
    "cavi": cavi,
    "colourfulness": colourfulness,
    "watermark": watermark_energy,
    "white_border": white_border,
}


def measure(df: DataFrame, key: str, names: list[str] | None = None, measures: dict = MEASURES) -> DataFrame:
    """(key, height, width, channels, pixels) to (key, *measures, phash); an image that can't be read has nulls."""
    chosen = names or list(measures)

    def of(h, w, c, raw) -> list:
        try:
            image = pixels(int(h), int(w), int(c), raw)
            return [*[float(measures[n](image)) for n in chosen], perceptual_hash(image)]
        except (ValueError, TypeError):
            return [None] * (len(chosen) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                rows = [of(*r) for r in zip(*[part.column(n).to_pylist() for n in ("height", "width", "channels", "pixels")], strict=True)]
                made = [pa.array([r[i] for r in rows], type=pa.int64() if i == len(chosen) else pa.float64()) for i in range(len(chosen) + 1)]
                yield pa.RecordBatch.from_arrays([part.column(key), *made], names=[key, *chosen, "phash"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "height", "width", "channels", "pixels").mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in chosen) + ", phash bigint")


def verdict(colourful: Column, sharp: Column, white: Column) -> Column:
    """Approved by colour, sharpness and background."""
    return F.when(~colourful.between(15, 95), "COLOUR").when(sharp < 50, "BLURRED").when(white < 0.9, "BACKGROUND").otherwise("APPROVED")


def _orientation(segment: bytes) -> int:
    """The orientation tag of an EXIF segment, 1 without one."""
    if segment[:6] != b"Exif\0\0":
        return 1
    tiff = segment[6:]
    order = "little" if tiff[:2] == b"II" else "big"
    number = lambda at, size: int.from_bytes(tiff[at : at + size], order)
    first = number(4, 4)
    for i in range(min(number(first, 2), 200)):
        at = first + 2 + 12 * i
        if number(at, 2) == 0x0112:
            return number(at + 8, 2)
    return 1


def jpeg_size(head: bytes) -> tuple[int, int] | None:
    """(width, height) of a JPEG from the markers at its head, turned as its orientation says; None for others."""
    if head[:2] != b"\xff\xd8":
        return None
    at, turned = 2, False
    while at + 9 <= len(head):
        if head[at] != 0xFF:
            return None
        marker = head[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD9 or marker == 0x01:
            at += 1 if marker == 0xFF else 2
            continue
        length = int.from_bytes(head[at + 2 : at + 4], "big")
        if marker == 0xE1:
            turned = _orientation(head[at + 4 : at + 2 + length]) >= 5
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = int.from_bytes(head[at + 5 : at + 7], "big"), int.from_bytes(head[at + 7 : at + 9], "big")
            return (height, width) if turned else (width, height)
        at += 2 + length
    return None


def jpeg_dimensions(c: Column) -> Column:
    """struct(width, height) of JPEG heads; null for others."""

    @F.pandas_udf("width int, height int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sizes = [jpeg_size(bytes(b)) if b is not None else None for b in x]
            yield pd.DataFrame([s or (None, None) for s in sizes], columns=["width", "height"]).astype("Int32")

    return run(c)
