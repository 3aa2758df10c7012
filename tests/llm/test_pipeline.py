import re

import corpus_pipeline
import numpy as np
import pytest

from weftnet.llm import mixing, set_join, suffix_dedup, toxicity

COLS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = [n for n, _ in corpus_pipeline.STAGES]


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(900)]
    passage = " ".join(rng.choice(vocabulary, 55))
    rows = []
    for k in range(120):
        t = " ".join(rng.choice(vocabulary, int(rng.integers(3, 90))))
        if k % 9 == 0:
            t += "\n" + passage
        rows.append((k, t, "en", f"s{k % 4}" if k % 5 else None, len(t)))
        if k % 6 == 0:
            rows.append((1000 + k, t, "en", "s1", len(t)))
    rows += [(5000, None, None, None, None), (5001, "", "en", "s1", 0), (None, "alone here", "en", "s2", 10), (7, rows[8][1], "en", "s3", 5)]
    return spark.createDataFrame(rows, COLS)


def test_stages_in_order():
    assert NAMES == ["toxicity", "jaccard", "repeats", "mix", "pack"]


def test_toxic_stage(spark, docs):
    bad = spark.createDataFrame([(9000 + k, f"some words zog here {k}", "en", "s1", 5) for k in range(60)], COLS)
    good = spark.createDataFrame([(8000 + k, f"some words fine here {k}", "en", "s1", 5) for k in range(60)], COLS)
    labels = spark.createDataFrame([(9000 + k, 1, 1) for k in range(40)] + [(8000 + k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    both = docs.union(bad).union(good)
    got = [r["doc_id"] for r in toxicity.drop_toxic(both, labels).collect()]
    scores = {(r["doc_id"]): r["predicted"] for r in toxicity.classify(both, labels).collect()}
    assert sorted(map(str, got)) == sorted(str(r["doc_id"]) for r in both.collect() if not scores[r["doc_id"]])
    assert not set(range(9000, 9060)) & set(got) and set(range(8000, 8060)) <= set(got)


def test_jaccard_stage(spark, docs):
    got = set_join.representatives(docs).collect()
    groups = {(r["doc_id"], r["component_id"]) for r in set_join.join(docs).collect()}
    want = {d for d, c in groups if d == c or d is None}
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, want))
    assert set_join.representatives(docs.limit(0)).collect() == []


def test_repeats_stage(spark, docs):
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in suffix_dedup.cut(docs).collect())
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    least, want = {}, []
    for d, t in rows:
        d = 1 << 63 if d is None else d
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(least.get(t[k : k + 50], d), d)
    for d, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < (1 << 63 if d is None else d):
                gone[k : k + 50] = [True] * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g).decode("utf-8", "replace")
        if not any(gone) or kept.strip():
            want.append((str(d), kept))
    assert got == sorted(want)
    assert suffix_dedup.cut(docs.limit(0)).collect() == []


def test_mix_stage(spark, docs):
    taken, size = {}, {}
    for r in mixing.mix(docs).collect():
        taken.setdefault(r["doc_id"], []).append(r["taken"])
        size.setdefault(r["doc_id"], []).append(r["size"])
    words = {}
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in mixing.apply(docs).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(word_list(r["text"]))
        assert any(t.startswith(r["text"]) for t in texts[r["doc_id"]]) and r["n_chars"] is not None
    assert words == {d: sum(t) for d, t in taken.items() if sum(t)}
    assert all(t <= 2 * s for d in taken for t, s in zip(taken[d], size[d], strict=True))
    assert mixing.apply(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []


def test_mix_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    room = {s: 2 * sum(r["size"] for r in by[s]) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * total
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > room[s]}
        if not over:
            target |= share
            break
        target |= {s: room[s] for s in over}
        left -= sum(room[s] for s in over)
        open_ -= over
    for s in sources:
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= max(2, 0.01 * target[s])


def test_shard_quotas(spark, docs):
    """Highest quotients, granted one by one in a plain loop, shard after shard."""
    blocks, shards = 500, 5
    target = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    total = sum(len(word_list(r["text"])) for r in docs.collect())
    each = max(1, -(-3 * total // (2 * blocks)))
    house = round(1.5 * total / each)
    order = sorted((s for s in target if target[s] > 0), key=lambda s: (s is None, s or ""))
    seats, want = dict.fromkeys(order, 0), {}
    for k in range(house):
        best = max(order, key=lambda s: (target[s] / (2 * seats[s] + 1), -order.index(s)))
        seats[best] += 1
        key = (best, k * shards // house)
        want[key] = want.get(key, 0) + 1
    got = {(r["source"], r["shard"]): r["blocks"] for r in mixing.shard_quotas(docs, blocks=blocks, shards=shards).collect()}
    assert got == want


def test_run(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 9 == 0)) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_clashing_columns(spark, docs):
    """Extra columns of any name come out as they went in, and change nothing else."""
    names = ["id", "size", "taken", "first", "line", "words", "row_key", "rank", "spans", "known", "k", "key", "nth", "stays", "place", "head", "of", "row"]
    few = docs.where("doc_id < 40 or doc_id > 1000")
    wide = few.selectExpr("*", *(f"cast(coalesce(doc_id, 0) * 100 + {n} as int) as `{c}`" for n, c in enumerate(names)))
    for stage in (set_join.representatives, suffix_dedup.cut, mixing.apply):
        got, want = stage(wide), stage(few)
        assert got.columns == wide.columns
        found = got.collect()
        assert sorted(map(str, (tuple(r)[:5] for r in found))) == sorted(map(str, map(tuple, want.collect())))
        assert all(r[c] == (r["doc_id"] or 0) * 100 + n for r in found for n, c in enumerate(names))
