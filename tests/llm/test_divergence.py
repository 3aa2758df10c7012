import random
import re
from collections import Counter, defaultdict

import pytest

from weftnet.llm import divergence as dv


def brute(rows, least, top):
    docs = [tuple(x or "" for x in r) for r in rows]
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    words = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(low)) for text, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [(w, d[2]) for w, d in zip(words, docs, strict=True) if d[1] == lang]
        df = Counter(t for w, _ in mine for t in set(w))
        kept = [t for t, n in df.items() if n >= least]
        counts = defaultdict(Counter)
        for w, source in mine:
            counts[source].update(t for t in w if df[t] >= least)
        whole = sum(counts.values(), Counter())

        def share(c):
            size = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (size + 5 * len(kept)) for t in kept}

        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        for s in p:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    names = [f"{a}{b}" for a in ("alpha", "Beta", "ünï", "漢字", "a", "ab") for b in ("", "x", "xy", "Z")]
    out = []
    for k in range(300):
        sep = rng.choice([" ", "  ", "-", "1", "\x00", ", "])
        text = sep.join(rng.choice(names[: rng.randint(3, len(names))]) for _ in range(rng.randint(0, 30)))
        out.append((text, rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "ß", None, f"t{k % 7}"])))
    out += [(None, None, None), ("", "xx", "s9"), ("only here", "xx", "s8"), ("word " * 50000, "en", "s1"), ("漢" * 30000, "de", "s1")]
    return out + [out[0], out[0], ("same same", "en", "tie1"), ("same same", "en", "tie2")]


@pytest.mark.parametrize(("least", "most_bytes", "bucket"), [(5, dv.MOST_BYTES, dv.BUCKET), (2, 60, 7)])
def test_against_brute_force(spark, rows, least, most_bytes, bucket, monkeypatch):
    """With one automaton and bucket, and with many small ones; extra columns have names of the operator's own."""
    monkeypatch.setattr(dv.audit, "__defaults__", (least, dv.TOP))
    monkeypatch.setattr(dv.occurrences, "__defaults__", (most_bytes,))
    monkeypatch.setattr(dv.distances, "__defaults__", (bucket,))
    docs = spark.createDataFrame([(None if k % 9 == 0 else k, *r, 1, "x") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, term string")
    got = sorted(tuple(r) for r in dv.audit(docs.repartition(5)).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(rows, least, dv.TOP)


def test_tiles_and_chunks(spark, rows, monkeypatch):
    """Tiles of sources, and products in small portions, add up to the same."""
    import pyarrow as pa

    rng = random.Random(1)
    p0 = [rng.randrange(5, 9) for _ in range(9)]
    posts = [(t, s, rng.randrange(5, 50)) for t in range(40) for s in range(9) if rng.random() < 0.4]

    def total():
        sums = Counter()
        for tile in range(-(-9 // dv.TILE)):
            part = pa.table({"lang": ["x"] * (len(posts) + 9), "tile": [tile] * (len(posts) + 9), "idx": [s for _, s, _ in posts] + list(range(9)), "term": pa.array([b"%d" % t for t, _, _ in posts] + [None] * 9, pa.binary()), "p": [p for _, _, p in posts] + p0})
            for r in dv._compare(part).to_pylist():
                sums[r["a"], r["b"]] += r["value"]
        return sums

    whole = total()
    monkeypatch.setattr(dv, "TILE", 4)
    monkeypatch.setattr(dv, "PRODUCTS", 3)
    assert total() == whole
    at = {(t, s): p for t, s, p in posts}
    for (a, b), v in whole.items():
        assert v + 40 * abs(p0[a] - p0[b]) == sum(abs(at.get((t, a), p0[a]) - at.get((t, b), p0[b])) for t in range(40))


def test_nothing_kept_and_nothing_there(spark, odd_docs):
    got = {(r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in dv.audit(odd_docs).where("lang = 'en'").collect()}
    assert got == {(a, "pair", b, 0, 1 + [x for x in ("s1", "s2", "s3") if x != a].index(b)) for a in ("s1", "s2", "s3") for b in ("s1", "s2", "s3") if a != b}
    assert dv.audit(odd_docs.limit(0)).collect() == []
