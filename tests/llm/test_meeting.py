"""op10: what is left out before suffixes are sorted cannot repeat."""

import numpy as np

from lantern.llm import suffixes


def test_only_what_can_repeat_is_sorted():
    r = np.random.default_rng(4)
    text = lambda n: r.integers(97, 123, n, dtype=np.uint8).tobytes()
    shared, long = text(130), text(400)
    segments = [text(300), text(50) + shared + text(90), b"", text(20), shared[:120] + text(80), long, long[30:250] + text(40), b"a" * 240, text(99)]
    parts = suffixes.meeting(segments)
    assert {i for i, _, _ in parts} == {1, 4, 5, 6, 7}
    assert sum(len(x) for _, _, x in parts) < sum(map(len, segments)) // 2 + 240
    assert all(segments[i][at : at + len(x)] == x for i, at, x in parts)
    order = [(i, 0, 7 * i) for i in range(len(segments))]

    def places(found, begin):
        return {(begin[i][0], begin[i][2] + p) for i, a, b in found for p in range(a, b + 1)}

    seen, want = set(), set()
    for i, s in enumerate(segments):
        for p in range(len(s) - suffixes.LENGTH + 1):
            w = s[p : p + suffixes.LENGTH]
            want |= {(i, 7 * i + p)} if w in seen else set()
            seen.add(w)
    begin = [(i, 0, 7 * i + at) for i, at, _ in parts]
    assert places(suffixes.repeated(segments, order), order) == places(suffixes.repeated([x for _, _, x in parts], begin), begin) == want
    assert suffixes.meeting([text(500), text(300)]) == [] == suffixes.meeting([])


def test_rows_have_one_number_where_it_fits():
    r = np.random.default_rng(5)
    for most in (3, 1 << 20, 1 << 40):
        columns = [r.integers(0, most, 500) for _ in range(3)]
        order, name = suffixes.names(columns)
        rows = list(zip(*[c.tolist() for c in columns]))
        rank = {x: i for i, x in enumerate(sorted(set(rows)), 1)}
        assert name.tolist() == [rank[x] for x in rows] and [rows[i] for i in order] == sorted(rows)
        assert (suffixes.joined(columns) is None) == (most > 1 << 21)
