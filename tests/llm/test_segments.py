"""Segments of shingle sets, by plain Python."""

import numpy as np
import pytest

from caselog.llm import jaccard


@pytest.mark.parametrize("n", [4, 5, 9, 60, 470, 5000, 300_000])
def test_segments_are_grouped_in_order(n):
    elements = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    band = jaccard.band_of(len(elements))
    number, hashes = jaccard._segment(elements, band)
    by_segment = {}
    for i, h in zip(number.tolist(), hashes.tolist()):
        by_segment.setdefault(i, []).append(h)
    segments, sums, sizes, of, mixed = jaccard._subsets(elements, band)
    assert segments.tolist() == sorted(by_segment)
    assert sizes.tolist() == [len(by_segment[i]) for i in sorted(by_segment)]
    assert sums.tolist() == [sum(by_segment[i]) % 2**64 for i in sorted(by_segment)]
    assert mixed.tolist() == [h for i in sorted(by_segment) for h in by_segment[i]]
    assert jaccard.profile(elements)[0] == len(by_segment)


def test_shingle_sets_are_sorted_and_distinct():
    found = jaccard.shingle_set("A b c d e a B c d e f " * 3).tolist()
    assert found == sorted(set(found)) and len(found) == len(set(jaccard.shingle_set("a b c d e a b c d e f " * 9).tolist()))
    assert len(jaccard.shingle_set("one")) == 1 and len(jaccard.shingle_set(None)) == 0
