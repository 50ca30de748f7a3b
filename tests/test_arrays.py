"""Files of one JSON array, cut into many blocks."""

import json
import random

from pathwatch.schema import TRACEROUTE
from pathwatch.sources import arrays, tables


def record(g, k):
    odd = ["plain", "}{", '"', "\\", '\\"}', "},{", "é日\U0001f389", "]", "", "\n}"]
    hops = [{"hop": h, "result": [{"from": f"10.0.0.{h}", "rtt": h + 0.5}, {"x": "*"}][: g.randrange(3)]} for h in range(g.randrange(4))]
    return {"timestamp": k, "af": 4, "msm_id": g.randrange(5), "prb_id": k, "src_addr": g.choice(odd), "dst_addr": "".join(g.choices(odd, k=3)), "more": {"a": [{}, {"b": g.choice(odd)}]}, "result": hops}


def test_blocks_give_the_whole_array(spark, tmp_path):
    g = random.Random(1)
    made = []
    for name, how in {"a": {}, "b": {"indent": 1}, "c": {"separators": (",", ":"), "ensure_ascii": False}}.items():
        made.append([record(g, 1000 * len(made) + k) for k in range(40)])
        (tmp_path / f"{name}.json").write_text(json.dumps(made[-1], **how) + "\n")
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "nothing.json").write_text("")
    (tmp_path / "broken.json").write_text('[{"prb_id": 1}, {"prb_id": 2')
    want = [json.dumps(x, sort_keys=True) for y in made for x in y] + ['{"prb_id": 1}']
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("300", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = [json.dumps(json.loads(r.record), sort_keys=True) for r in arrays.records(spark, str(tmp_path)).collect()]
            assert sorted(got) == sorted(want)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        read = lambda **how: sorted(map(repr, tables.read_traceroutes(spark, f"{tmp_path}/[abc].json", arrays=True, **how).collect()))
        assert read() == read(whole_files=True) and len(read()) == 120
        assert tables.read_traceroutes(spark, f"{tmp_path}/empty.json", arrays=True).count() == 0
        assert tables.read_traceroutes(spark, f"{tmp_path}/empty.json", arrays=True).schema == spark.createDataFrame([], TRACEROUTE).schema
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
