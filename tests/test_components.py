"""Objects of a mask against a flood fill, and the gates that look at them."""

import numpy as np
import pytest

from shelfloom.functions import images


def flood(mask, diagonal=True):
    labels, n = np.zeros(mask.shape, int), 0
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not a * b)]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if labels[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        labels[y, x] = n
        while todo:
            i, j = todo.pop()
            for a, b in near:
                if 0 <= i + a < mask.shape[0] and 0 <= j + b < mask.shape[1] and mask[i + a, j + b] and not labels[i + a, j + b]:
                    labels[i + a, j + b] = n
                    todo.append((i + a, j + b))
    return labels, n


@pytest.mark.parametrize("share", [0.0, 0.1, 0.3, 0.5, 0.7, 0.95, 1.0])
def test_components_equal_a_flood_fill(share):
    random = np.random.default_rng(int(share * 100))
    for shape in ((1, 1), (1, 30), (30, 1), (17, 23), (40, 40)):
        for diagonal in (True, False):
            mask = random.random(shape) < share
            got, n = images.components(mask, diagonal)
            want, m = flood(mask, diagonal)
            assert n == m and (got == want).all()


def test_holes_and_objects_inside_holes():
    mask = np.zeros((20, 30), bool)
    mask[2:12, 3:13] = True
    mask[4:10, 5:11] = False
    mask[6:8, 7:9] = True  # inside the hole: no outermost object
    mask[15, 20:25] = True
    mask[16, 25] = True  # at a corner
    got = images.objects(mask)
    assert got == [(3, 2, 10, 10, 100, 81.0), (20, 15, 6, 2, 6, 0.0)]
    assert images.largest(mask) == (3, 2, 10, 10) and images.largest(np.zeros((3, 3), bool)) is None
    assert (images.filled(mask)[2:12, 3:13]).all() and images.filled(mask).sum() == 106
    diagonal = np.eye(6, dtype=bool)
    assert images.objects(diagonal) == [(0, 0, 6, 6, 6, 0.0)]
    triangle = np.tril(np.ones((5, 5), bool))
    assert images.objects(triangle)[0][5] == 8.0  # half of four by four


def picture(side=20, level=0):
    out = np.full((side, side, 3), 255.0)
    return out, level


def test_corners_count_twice_where_full_rows_and_columns_are_stacked():
    image = np.full((100, 120, 3), 255.0)
    image[:10, :10] = 0  # a corner block
    want = (2 * 10 * 120 + 2 * 10 * 100 - 2 * 100) / (2 * 10 * 120 + 2 * 10 * 100)
    assert images.background_gate("strict", image)[0] == pytest.approx(want)
    assert images.background_gate("perimeter", image)[0] == pytest.approx(1 - (36 + 24 + 4) / (6 * 120 * 2 + 6 * 88 * 2), abs=0.02)
    big = np.full((400, 400, 3), 255.0)
    big[0, 0] = 0
    assert images.background_gate("original", big)[0] == pytest.approx(1 - 2 / 1600)


def test_compliance_takes_the_largest_object_and_has_no_verdict():
    image = np.full((60, 80, 3), 255.0)
    image[10:30, 10:40] = 20
    image[50:55, 60:75] = 20
    purity, fill, passed = images.background_gate("compliance", image)
    assert (purity, fill, passed) == (1.0, pytest.approx(20 * 30 / 4800), None)
    assert images.largest_fill(image) == pytest.approx(20 * 30 / 4800)
    assert images.layout(image)[0] == pytest.approx(45 * 65 / 4800)  # of all objects
    image[0, :40, 0] = 0
    assert images.background_gate("compliance", image)[0] == pytest.approx(1 - 41 / (3 * 280))
    assert images.background_gate("compliance", np.full((9, 9, 3), 255.0)) == (0.0, 0.0, None)


def test_layout():
    image = np.full((100, 100, 3), 255.0)
    assert images.layout(image) == (0.0, 1.0, False)
    image[40:60, 40:60] = 0
    assert images.layout(image) == (pytest.approx(0.04), pytest.approx(0.005), True)
    image = np.roll(image, 15, axis=1)
    assert images.layout(image)[1:] == (pytest.approx(0.145), False)
