import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from weftnet.llm import license_scan as ls
from weftnet.llm import media


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in ls.PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_scan(spark, odd_docs):
    texts = ["Licensed under CC BY-NC 4.0.", "see the\nMIT-License, the mit license", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
             "gnu general public licenses", "Licensed under the Apache License, Version 2.0.", "Ächt cc by by", "apache license apache license", "cc by"]
    docs = odd_docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(k + 20, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string"))
    rows = ls.scan(docs).collect()
    text = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], r["text"])
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text[r["doc_id"]])
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert len(rows) == docs.count() and ls.scan(docs.limit(0)).collect() == []
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert labels[20] == "cc-by,cc-by-nc" and labels[22] == "mit,mit-notice" and labels[23] == "gpl,gpl-notice" and labels[25] == "apache,apache-2.0"


def test_automaton():
    a = ls.Automaton("[[this {{1-3}} is]] {licensed|released} under [[the|a]] foo license [[version {{1-2}}]]")
    t = lambda s: s.encode().split()
    assert a.match(t("licensed under foo license"), 0) == 4
    assert a.match(t("this big old thing is released under a foo license version 2 0 end"), 0) == 13
    assert a.match(t("this one two three four is released under foo license"), 0) is None
    assert a.match(t("licensed under the bar license"), 0) is None
    assert a.find(t("x licensed under the foo license y released under foo license")) == [(1, 6), (7, 11)]


#: Published licence texts as they stand in files.
WORDING = {
    "mit-text": """Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}


def test_published_wording():
    """Whole texts are accepted whatever their case and punctuation; one word less or other is not."""
    words = lambda text: text.encode().translate(ls.TABLE).split()
    automata = {label: ls.Automaton(t) for label, t in ls.TEMPLATES.items()}
    for label, text in WORDING.items():
        w = words("before it " + text + " after it")
        assert len(automata[label].find(w)) == 1
        assert {k for k, a in automata.items() if a.find(w)} == {label}
        for k in (len(w) // 3, len(w) - 4):
            assert not automata[label].find(w[:k] + w[k + 1 :]) and not automata[label].find([*w[:k], b"other", *w[k + 1 :]])
    other = WORDING["mit-text"].replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM")
    assert automata["mit-text"].find(words(other))


def as_regex(template):
    """The template as a regular expression over words that each end in a blank."""
    out = ""
    for mark in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|\{[^{}]+\}|\||[^\s\[\]{}|]+", template):
        if mark.startswith("{{"):
            out += "(?:[^ ]+ ){%s}" % mark[2:-2].replace("-", ",")
        elif mark.startswith("{"):
            out += "(?:" + "|".join(map(re.escape, mark[1:-1].split("|"))) + ") "
        else:
            out += {"[[": "(?:", "]]": ")?", "|": "|"}.get(mark) or re.escape(mark) + " "
    return re.compile("(?:^|(?<= ))" + out)


def sampled(template, rng):
    """Words that the template accepts, by chance choices in its regions."""
    out, skip = [], 0
    for mark in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|\{[^{}]+\}|\||[^\s\[\]{}|]+", template):
        if mark == "[[":
            skip += 1 if skip else rng.integers(2)
        elif mark == "]]":
            skip = max(0, skip - 1)
        elif mark == "|":
            skip = skip or 1
        elif not skip and mark.startswith("{{"):
            least, most = map(int, mark[2:-2].split("-"))
            out += ["xyzzy", "the", "0"][: least] + ["w"] * int(rng.integers(0, most - least + 1)) if least <= 3 else ["w"] * least
        elif not skip:
            out.append(str(rng.choice(mark.strip("{}").split("|"))))
    return out


def test_labels_equal_a_brute_force(spark):
    """Labels of texts that templates accept, of texts a word away and of none, against regular expressions tried at every word."""
    rng = np.random.default_rng(4)
    texts = []
    for template in ls.TEMPLATES.values():
        for _ in range(6):
            words = ["before", "it", *sampled(template, rng), "after"]
            texts.append(" ".join(words))
            k = int(rng.integers(2, len(words)))
            texts.append(", ".join(words[:k] + words[k + 1 :]))
            texts.append("\n".join([*words[:k], "other", *words[k:]]).upper())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ls.scan(docs).collect()}
    regexes, seen = {k: as_regex(t) for k, t in ls.TEMPLATES.items()}, set()
    for k, text in enumerate(texts):
        line = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) + " "
        want = {label for label, x in regexes.items() if x.search(line)}
        assert set(filter(None, got[k]["labels"].split(","))) - set(ls.PHRASES.values()) == want - set(ls.PHRASES.values()), text
        assert {s["label"] for s in got[k]["spans"]} == want
        seen |= want
    assert seen == set(ls.TEMPLATES)


def test_long_and_repeated_texts(spark):
    """A text of a million words with a licence at its end, and rows that repeat it."""
    text = "word " * 1_000_000 + WORDING["isc"]
    rows = ls.scan(spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")).collect()
    assert [r["labels"] for r in rows] == ["isc", "isc", ""] and rows[0]["spans"][0]["first"] == 1_000_000 and rows[0]["n_words"] == rows[1]["n_words"]


def test_media_equal_a_brute_force(spark, odd_docs):
    """The stored form's digest and the feature, sample by sample."""
    from collections import Counter
    from math import log2, sqrt

    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(900, "é" * 300_000), (901, "same"), (902, "same")], "doc_id long, text string"))
    stored = media.store(docs)
    placed = media.resolve(media.sequences(media.document_pages(stored), "key"), media.features(stored), "key").collect()
    want = []
    for r in docs.collect():
        data = (r["text"] or "").encode()
        while len(data) % 64 or not data:
            data += b"\0"
        pgm = f"P5\n64 {len(data) // 64}\n255\n".encode() + data
        counts, n = Counter(data), len(data)
        mean = sum(v * c for v, c in counts.items()) / n
        std = sqrt(sum(c * (v - mean) ** 2 for v, c in counts.items()) / n)
        entropy = -sum(c / n * log2(c / n) for c in counts.values())
        peak = min(v for v, c in counts.items() if c == max(counts.values()))
        want.append((hashlib.sha256(pgm).hexdigest(), len(pgm), f"{n // 64}x64;mean={mean:.4f};std={std:.4f};entropy={entropy + 0.0:.4f};peak={peak}"))
    got = sorted((r["media_sha256"], r["media_bytes"], r["feature"].replace("entropy=-0.0000", "entropy=0.0000")) for r in placed)
    assert got == sorted((a, b, c.replace("entropy=-0.0000", "entropy=0.0000")) for a, b, c in want)


def test_store_round_trip(spark, odd_docs):
    stored = media.store(odd_docs)
    placed = media.resolve(media.sequences(media.document_pages(stored), "key"), media.features(stored), "key").collect()
    texts = sorted((r["text"] or "").encode() for r in odd_docs.collect())
    assert len(placed) == len(texts)
    want = sorted((str(len(t)), len(p := t + bytes(-len(t) % 64 or (0 if t else 64))), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for t in texts)
    assert sorted((r["caption"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in placed) == want
    assert all(r["media_bytes"] > r["payload_bytes"] for r in placed)
    assert media.features(media.store(odd_docs.limit(0))).collect() == []


def test_sequences(spark):
    html = "<p>one <b>two</b></p><figure><img src='a.png' alt='A'><img src='data:image/png;base64,AAAA'><figcaption>both</figcaption></figure><script>x</script>three<video src=v.mp4></video>"
    rows = media.sequences(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("page_id").collect()
    kinds = [(i["position"], i["kind"], i["text"], i["alt"], i["caption"]) for i in rows[0]["items"]]
    assert kinds == [(0, "text", "one two", None, None), (1, "image", None, "A", "both"), (2, "image", None, None, "both"), (3, "text", "three", None, None), (4, "video", None, None, None)]
    assert rows[0]["items"][2]["digest"] == hashlib.sha256(bytes(3)).hexdigest() and rows[1]["items"] == rows[2]["items"] == []
    found = spark.createDataFrame([(hashlib.sha256(bytes(3)).hexdigest(), 3)], "digest string, payload_bytes long")
    got = media.resolve(spark.createDataFrame([], "page_id long, items array<struct<position:int,kind:string,text:string,source:string,digest:string,alt:string,caption:string>>"), found)
    assert got.agg(F.count("*")).first()[0] == 0
