"""Status of keys that fall silent on a stream, against a plain replay; overlap of distinct field sets."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import catalog
from tidemark.streaming import jobs

HOUR = timedelta(hours=1)
START = datetime(2024, 1, 1)


def replay(times, until, warn=1, fail=5):
    """(at, status) of one key whose events are known up to ``until``."""
    out, known = [], sorted(t for t in set(times) if t < until)
    for i, t in enumerate(known):
        if i == 0 or t - known[i - 1] > warn * HOUR:
            out.append((t, "pass"))
        after = known[i + 1] if i + 1 < len(known) else until
        out += [(t + n * HOUR, s) for n, s in ((warn, "warn"), (fail, "fail")) if t + n * HOUR < after]
    return out


def run(spark, tmp_path, arrivals, delay="2 hours"):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for batch in [*arrivals, None]:
        if batch is not None:
            spark.createDataFrame(batch, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema("k string, ts timestamp").parquet(folder)
        query = jobs.live_status(source, "ts", "k", delay=delay).writeStream.format("parquet").option("path", out)
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows(spark.read.schema("k string, at timestamp, status string").parquet(out))


def want(arrivals, delay=2):
    events = [e for batch in arrivals for e in batch if e[0] is not None and e[1] is not None]
    until = max(t for _, t in events) - delay * HOUR
    return sorted((k, at, s) for k in {k for k, _ in events} for at, s in replay([t for n, t in events if n == k], until))


def test_silent_key_warns_and_fails_without_an_event(spark, tmp_path):
    arrivals = [
        [("busy", START), ("silent", START), ("busy", START + 0.5 * HOUR), (None, START), ("none", None)],
        [("busy", START + 4 * HOUR)],
        [("busy", START + 10 * HOUR), ("late", START + 9 * HOUR)],
    ]
    got = run(spark, tmp_path, arrivals)
    assert got == want(arrivals)
    assert [(r[1], r[2]) for r in got if r[0] == "silent"] == [(START, "pass"), (START + HOUR, "warn"), (START + 5 * HOUR, "fail")]


def test_events_out_of_order_within_the_delay_equal_a_replay(spark, tmp_path):
    rng = random.Random(3)
    events = [(rng.choice("abc"), START + timedelta(minutes=m)) for m in range(0, 3000, 7) if rng.random() < 0.12 or m % 900 < 60]
    events += events[::9]  # repeats
    # each event is at most 110 minutes later than one that came before it
    dealt = sorted(events, key=lambda e: e[1] + timedelta(minutes=rng.uniform(0, 110)))
    arrivals = [dealt[i : i + len(dealt) // 3 + 1] for i in range(0, len(dealt), len(dealt) // 3 + 1)]
    assert run(spark, tmp_path, arrivals) == want(arrivals)


def test_thinned_times_keep_every_long_silence():
    rng = random.Random(4)
    for _ in range(300):
        times = sorted(rng.randrange(200) for _ in range(rng.randrange(40)))
        warn = rng.randrange(1, 30)
        kept = jobs.thinned(times, warn)
        gaps = lambda x: [(a, b) for a, b in zip(x, x[1:]) if b - a > warn]  # noqa: E731, B023, B905
        assert gaps(kept) == gaps(sorted(set(times)))
        assert (kept[:1], kept[-1:]) == (times[:1], times[-1:])
        assert len(kept) <= 2 * 200 / warn + 3


def test_signatures_meet_by_shared_names_and_copies_add_no_pairs(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(12)]
    sets = [(f"a{i}", rng.choice(["topic", "table"]), sorted(rng.sample(names, rng.randrange(4)))) for i in range(60)]
    sets += [(f"hot{i}", "table", ["n1", "n2"]) for i in range(500)]
    df = spark.createDataFrame(sets, "asset_id string, asset_type string, names array<string>").withColumn("asset_name", F.lit("x"))
    got = catalog.signature_overlap(df, "topic", "table").collect()
    left, right = ({tuple(n) for _, t, n in sets if t == kind and n} for kind in ("topic", "table"))
    pairs = {(a, b) for a in left for b in right if set(a) & set(b)}
    assert len(got) == len(pairs)
    assert max(r.n_right for r in got) >= 500
    by_id = {i: n for i, _, n in sets}
    for r in got:
        shared = sorted(set(by_id[r.first_left]) & set(by_id[r.first_right]))
        assert r.shared == ",".join(shared) and r.n_shared == len(shared)
