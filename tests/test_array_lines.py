"""Records as the lines of one JSON array."""

import json

import pandas as pd

from pathwatch.sources.arrays import as_array


def test_a_frame_for_each_batch_not_for_each_record():
    records = [{"n": k, "s": "a,[]{}"} for k in range(1000)]
    of = lambda rows: pd.DataFrame({"value": [json.dumps(r) for r in rows]}, dtype=object)
    frames = list(as_array(iter([of([]), of(records[:400]), of([]), of(records[400:])])))
    assert len(frames) == 3
    assert json.loads("\n".join(pd.concat(frames)["value"])) == records
    assert [f["value"].tolist() for f in as_array(iter([of([])]))] == [["[]"]]
