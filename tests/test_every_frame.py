"""The track queries over every frame, against brute force on the smallest tables."""

from collections import defaultdict

import pytest

from tessera.plans import catalogue
from tessera.sources.adapters import keys, spans

DATA = "/root/testdata/sf0.001"


def test_every_frame_has_its_tracks_and_boxes(spark):
    frames, known, want = defaultdict(set), defaultdict(dict), set()
    for r in keys(spark, DATA).collect():
        frames[r.media_id].add(r.frame)
        known[r.track_id][r.frame] = (r.x, r.y, r.w, r.h)
    for s in spans(spark, DATA).collect():
        want |= {(s.media_id, f, s.track_id, s.span_no) for f in frames[s.media_id] if s.start_frame <= f <= s.end_frame}
    got = catalogue.QUERIES["active_tracks"](spark, DATA).collect()
    assert len(got) == len(want) and {(r.media_id, r.frame, r.track_id, r.span_no) for r in got} == want
    assert any(f % 25 for _, f, _, _ in want)
    boxes = catalogue.QUERIES["interpolated_boxes"](spark, DATA).collect()
    asked = {(s.track_id, f) for s in spans(spark, DATA).collect() for f in frames[s.media_id] if s.start_frame <= f <= s.end_frame}
    assert sorted((r.track_id, r.frame) for r in boxes) == sorted(asked)
    for r in boxes:
        k = known[r.track_id]
        a, b = max(f for f in k if f <= r.frame), min(f for f in k if f >= r.frame)
        t = (r.frame - a) / (b - a) if b > a else 0.0
        assert (r.x, r.y, r.w, r.h) == pytest.approx([p + (q - p) * t for p, q in zip(k[a], k[b], strict=True)], abs=1e-6)
