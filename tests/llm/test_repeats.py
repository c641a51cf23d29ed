"""Substring and suffix dedup against brute force."""

import os
import re
import subprocess
import sys
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
import pytest
from pyspark.sql import functions as F

from barloom.llm import core, queries, repeats, substring, suffix

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_words(docs, size):
    seen, out = set(), {}
    for i, text in docs:
        w = WORD.findall((text or "").encode())
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            k = b" ".join(w[p : p + size])
            if k in seen:
                gone[p : p + size] = [True] * size
            seen.add(k)
        out[i] = (len(w), sum(gone), sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def brute_bytes(docs, size):
    least, out = {}, {}
    for i, text in docs:
        b = (text or "").encode()
        for p in range(len(b) - size + 1):
            least.setdefault(b[p : p + size], i)
    for i, text in docs:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if least[b[p : p + size]] < i:
                gone[p : p + size] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), len(repeats.spans(gone)[0]), sha256(kept).hexdigest())
    return out


def noisy(seed, n):
    """Documents that copy pieces of each other, with nulls, empties, long and periodic texts."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(40)]
    docs = [None, "", " \t\n", "a " * 300, "aaaa" * 200, "aaaa" * 200, "x\x0by\x0cz"]
    while len(docs) < n:
        parts = [rng.choice(vocab) for _ in range(rng.integers(1, 60))]
        for _ in range(rng.integers(0, 3)):
            other = docs[rng.integers(3, len(docs))].split()
            if other:
                a = rng.integers(0, len(other))
                parts += other[a : a + rng.integers(1, 60)]
        docs.append(str(rng.choice([" ", "\n"])).join(parts))
    return [(int(i), t) for i, t in enumerate(docs)]


def test_passages_of_many_blocks_meet_by_groups(spark, monkeypatch):
    """With groups of two blocks, what more hold goes through two shards; the rows are the same."""
    monkeypatch.setattr(repeats, "GROUP", 2)
    rng = np.random.default_rng(11)
    common = " ".join(f"c{i}" for i in range(40))
    docs = [(i, f"{' '.join(f'u{x}' for x in rng.integers(0, 10**6, 20))} {common} {' '.join(f'u{x}' for x in rng.integers(0, 10**6, 9))}") for i in range(60)]
    docs += [(100 + i, t) for i, (_, t) in enumerate(noisy(2, 60))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = substring.remove_repeats(df, 20, blocks=9).withColumn("h", F.sha2("text", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.h) for r in rows} == brute_words(docs, 20)
    rows = suffix.remove_repeats(df, 50, blocks=9).withColumn("h", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in rows} == brute_bytes(docs, 50)


def test_messages_by_relays_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(core, "RELAY", 1)
    monkeypatch.setattr(repeats, "GROUP", 3)
    docs = noisy(4, 120) + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for blocks in (2, 11):
        rows = substring.remove_repeats(df, 20, blocks=blocks).withColumn("h", F.sha2("text", 256)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.h) for r in rows} == brute_words(docs, 20)
    rows = suffix.remove_repeats(df, 50, blocks=11).withColumn("h", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in rows} == brute_bytes(docs, 50)


@pytest.mark.parametrize("n", [16, 49])
def test_messages_grow_less_than_their_square(spark, n):
    """Every sender has something for every receiver: a receiver opens a parcel for each group of senders, and misses nothing."""
    way = core.Relay("a", "b", n, n, "a int, b int, data binary", on=True)
    senders = spark.createDataFrame([(i,) for i in range(n)], "a int").groupBy("a")
    say = lambda t: pa.table({"a": pa.array([t["a"][0].as_py()] * n, pa.int32()), "b": pa.array(range(n), pa.int32()), "data": pa.array([bytes([x]) for x in range(n)], pa.binary())})
    made = way.send(senders, say)
    assert made.count() == n * (int((n - 1) ** 0.5) + 1)  # not n * n
    opened = made.groupBy("b").applyInArrow(lambda t: way.opened(t), "a int, b int, data binary").collect()
    assert {(r.a, r.b, bytes(r.data)) for r in opened} == {(i, j, bytes([j])) for i in range(n) for j in range(n)} and len(opened) == n * n


@pytest.mark.parametrize("blocks", [1, 6])
def test_substring_equals_brute_force(spark, blocks):
    docs = noisy(blocks, 120)
    df = spark.createDataFrame([(i, t, f"s{i}", "clash") for i, t in docs], "doc_id long, text string, block string, rest string")
    for size in (4, 20):
        got = substring.remove_repeats(df, size, carry=("block", "rest"), blocks=blocks)
        rows = got.withColumn("h", F.sha2("text", 256)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.h) for r in rows} == brute_words(docs, size)
        texts = dict(docs)
        for r in rows:
            w = WORD.findall((texts[r.doc_id] or "").encode())
            assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(0 <= s.start < s.end <= len(w) for s in r.spans)
            assert r.rest.block == f"s{r.doc_id}" and r.rest.rest == "clash"


@pytest.mark.parametrize("blocks", [1, 6])
def test_suffix_equals_brute_force(spark, blocks):
    docs = noisy(7 + blocks, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for size in (9, 50):
        got = suffix.remove_repeats(df, size, blocks=blocks).withColumn("h", F.sha2("kept", 256)).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in got} == brute_bytes(docs, size)


def test_queries_equal_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect())
    assert {r[0]: tuple(r)[1:] for r in queries.op3_substring_dedup(spark, sf).collect()} == brute_words(docs, 20)
    assert {r[0]: tuple(r)[1:] for r in queries.op8_suffix_dedup(spark, sf).collect()} == brute_bytes(docs, 50)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text[:60])], "doc_id long, text string")
    rows = substring.remove_repeats(df, blocks=2).collect()
    assert sorted(r.n_removed for r in rows if r.doc_id != 9) == [0, 30, 30] and [r.n_removed for r in rows if r.doc_id is None] == [0]
    rows = suffix.remove_repeats(df, blocks=2).collect()
    assert [r.n_removed for r in rows if r.doc_id is None] == [0] and all(r.n_removed == r.n_bytes for r in rows if r.doc_id)
    assert substring.remove_repeats(df.limit(0)).count() == suffix.remove_repeats(df.limit(0)).count() == 0


def test_long_texts_are_taken_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    parts = [rng.integers(97, 100, int(rng.integers(10, 60))).astype(np.uint8) for _ in range(60)]
    parts += [parts[i] for i in rng.integers(0, 60, 60)]
    bounds, doc = np.append(0, np.cumsum([len(x) for x in parts])), np.sort(rng.integers(0, 40, len(parts)))
    whole = suffix.later(np.concatenate(parts), bounds, doc, 8)
    for size in (1, 100, 1000):
        monkeypatch.setattr(suffix, "SORTED", size)
        assert (suffix.later(np.concatenate(parts), bounds, doc, 8) == whole).all()


def test_two_stage_order():
    rng = np.random.default_rng(0)
    for trial in range(100):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 150)).astype(np.uint8)
        if trial % 3 == 0:
            t = np.repeat(t, rng.integers(1, 12, len(t)))
        depth = int(rng.integers(2, 20))
        sa = suffix.suffix_array(t, depth)
        assert sorted(sa.tolist()) == list(range(len(t)))
        whole = [k for i in sa if len(k := bytes(t[i : i + depth])) == depth]
        assert whole == sorted(whole)


def test_automaton_finds_earlier_windows():
    rng = np.random.default_rng(1)
    for _ in range(150):
        size = int(rng.integers(2, 6))
        seqs = [rng.integers(0, 3, int(rng.integers(size, 25))).astype(np.uint64) for _ in range(int(rng.integers(1, 7)))]
        bounds, items = np.append(0, np.cumsum([len(x) for x in seqs])), np.concatenate(seqs)
        seen, want = set(), np.zeros(len(items), bool)
        for a, z in zip(bounds[:-1], bounds[1:]):
            for p in range(a, z - size + 1):
                k = items[p : p + size].tobytes()
                want[p] = k in seen
                seen.add(k)
        assert (substring.later(items, bounds, np.arange(len(seqs)), size) == want).all()


def shuffled(t, rng):
    return t.take(pa.array(rng.permutation(t.num_rows)))


@pytest.mark.parametrize("group", [256, 1])
@pytest.mark.parametrize("module, item_type", [(substring, np.uint64), (suffix, np.uint8)])
def test_order_of_fetched_rows_does_not_matter(module, item_type, group, monkeypatch):
    """The steps without Spark, with the rows of every group in another order each time they are read."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = np.random.default_rng(5)
    docs = noisy(3, 150) + [(149, None), (149, "a " * 300)]
    n, kind = 4, module.kind(12, 5)
    block = rng.integers(0, n, len(docs))
    tables = [pa.table({"block": pa.array([b] * int((block == b).sum()), pa.int32()), "doc_id": pa.array([d for (d, _), x in zip(docs, block) if x == b], pa.int64()), "text": pa.array([t for (_, t), x in zip(docs, block) if x == b], pa.string())}) for b in range(n)]

    def grouped(parts, key):
        t = pa.concat_tables(parts)
        return {k: t.filter(pc.equal(t[key], k)) for k in t[key].unique().to_pylist()}

    def removed(mix):
        asked = [repeats.ask(kind, n)(mix(t)) for t in tables]
        told = grouped([repeats.answer(2 * n)(mix(t)) for t in grouped(asked, "bucket").values()], "block")
        parts = [repeats.cut(kind, n)(mix(t), mix(told[b])) for b, t in enumerate(tables)]
        for _ in range(2):
            parts = [repeats.settle(kind, item_type, 2 * n)(mix(t)) for t in grouped(parts, "dest").values()]
        known = grouped(parts, "block")
        out = []
        for b, t in enumerate(tables):
            t = core.ordered(mix(t))
            items, at = kind.items(*core.flat(t["text"]))
            gone = repeats.covered(len(items), known.get(b, parts[0].slice(0, 0)), kind.length)
            out += [(i or -1, x or "", int(gone[p:q].sum())) for i, x, p, q in zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), at[:-1], at[1:])]
        return sorted(out)

    want = removed(lambda t: t)
    assert sum(x[2] for x in want)
    for _ in range(4):
        assert removed(lambda t: shuffled(t, rng)) == want


CLUSTER = """
import os, sys, threading, time
from pyspark.sql import SparkSession, functions as F
from barloom.llm import queries
spark = SparkSession.builder.master("local-cluster[3,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "6").config("spark.checkpoint.dir", sys.argv[2]).config("spark.executorEnv.PYTHONPATH", sys.path[0]).getOrCreate()
def lose_one():
    # an executor of this application goes when the second query has run for some stages
    tracker, app = spark.sparkContext.statusTracker(), spark.sparkContext.applicationId
    while not any(i > 3 for i in tracker.getActiveStageIds()):
        time.sleep(0.05)
    for pid in filter(str.isdigit, os.listdir("/proc")):
        try:
            command = open(f"/proc/{pid}/cmdline").read()
        except OSError:
            continue
        if "CoarseGrainedExecutorBackend" in command and app in command:
            os.kill(int(pid), 9)
            print("lost", pid, flush=True)
            return


if sys.argv[3:] == ["lose"]:
    threading.Thread(target=lose_one, daemon=True).start()
for name in ("op3_substring_dedup", "op8_suffix_dedup"):
    queries.QUERIES[name](spark, sys.argv[1]).write.parquet(sys.argv[2] + "/" + name)
spark.stop()
"""


def first_error(log: str) -> str:
    """The lines from the first exception or lost executor on, without stack frames; the end of a log is frames alone."""
    lines = [x for x in log.splitlines() if not x.lstrip().startswith(("at ", "..."))]
    hits = [i for i, x in enumerate(lines) if re.search(r"Exception|Error|Lost executor|ERROR", x)]
    return "\n".join(lines[hits[0] : hits[0] + 40]) if hits else log[-3000:]


@pytest.mark.parametrize("lose", [False, True])
def test_several_executors(spark, tmp_path, lose):
    """Both queries on executors that fetch each other's blocks, and when one of these is lost, give the rows that one process gives."""
    (tmp_path / "run.py").write_text(CLUSTER)
    env = os.environ | {"SPARK_HOME": os.path.dirname(pyspark.__file__), "SPARK_LOCAL_IP": "127.0.0.1"}
    home, root = "/root/testdata/sf0.01", env["PYTHONPATH"].split(os.pathsep)[0]
    run = "import sys; sys.path[0] = sys.argv[1]; del sys.argv[1]; exec(open(sys.argv.pop(1)).read())"
    done = subprocess.run([sys.executable, "-c", run, root, str(tmp_path / "run.py"), home, f"file://{tmp_path}/out", *["lose"] * lose], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, first_error(done.stderr)
    assert ("lost" in done.stdout) == lose
    for name in ("op3_substring_dedup", "op8_suffix_dedup"):
        got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out/{name}").collect()))
        assert got == sorted(map(tuple, queries.QUERIES[name](spark, home).collect()))
