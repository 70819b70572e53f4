"""The stream of newest versions: late, repeated and changed papers, over a restart, equal the batch."""

import json
import random

from evispark.operators.maintain import last_wins
from evispark.streaming.newest import current, ingest_newest

SCHEMA = "paper_id string, version long, title string, year int"


def write(folder, number, rows):
    folder.mkdir(exist_ok=True)
    names = ("paper_id", "version", "title", "year")
    (folder / f"{number:03}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))


def test_changes_add_up_to_the_batch_upsert(spark, tmp_path):
    draw, seen = random.Random(9), []
    source, out = tmp_path / "in", f"file://{tmp_path}/out"

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"file://{source}")
        query = ingest_newest(stream, "paper_id", ["version"], out, f"file://{tmp_path}/checkpoint")
        query.awaitTermination(240)
        assert query.exception() is None

    def more(number, rows):
        seen.extend(rows)
        write(source, number, rows)

    more(0, [("a", 2, "second", 2001), ("b", 1, "only", None), (None, 1, "no key", 1)])
    more(1, [("a", 1, "late", 2000), ("b", 1, "only", None)])
    run()
    more(2, [("a", 3, "third", None), ("c", None, "no version", 5), ("a", 2, "second", 2001)])
    more(3, [(draw.choice("abcd"), draw.randrange(9), draw.choice("xyz"), draw.choice([None, 1990, 2020])) for _ in range(30)])
    run()  # a restart goes on from the checkpoint
    want = last_wins(spark.createDataFrame([r for r in seen if r[0] is not None], SCHEMA), ["paper_id"], ["version"])
    rows = lambda df: sorted((str((r.paper_id, r.version, r.title, r.year)) for r in df.collect()))
    assert rows(current(spark, out, "paper_id")) == rows(want)
    changes = spark.read.parquet(out)
    assert changes.filter("change = 'retract' AND paper_id = 'a' AND version = 2").count() == 1
    assert changes.filter("title = 'late'").count() == 0 and changes.filter("title = 'only' AND change = 'assert'").count() == 1
