"""Operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from larkspur.llm import decontaminate, embedding_dedup, jaccard_join, mixing, quality_rules, secret_scan, site_tree, skew, substring_dedup, token_counts, warc
from larkspur.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, th string, key string, n string"
VOCABULARY = [f"w{i}" for i in range(400)] + ["Été", "Über", "x'y", "né,"]


def _low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    """Documents with every odd case; the last columns clash with names used inside operators."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(VOCABULARY, k=rng.choice([1, 3, 4, 9, 60, 200]))) for _ in range(60)]
    near = []
    for t in texts[:20]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    passage = " ".join(rng.choices(VOCABULARY, k=70))
    shared = [" ".join([*rng.choices(VOCABULARY, k=30), passage, *rng.choices(VOCABULARY, k=30)]) for _ in range(6)]
    texts += near + shared + texts[:5] + [None, "", " \n\t ", None, "ABC", "abc", " ".join(rng.choices(VOCABULARY, k=30_000))]
    made = [(i, t, "en", [None, "b", "a", "é"][i % 4], len(t or ""), "x", "x", "x", "x") for i, t in enumerate(texts)]
    return made + [made[3], (None, texts[3], None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    expected = _components({x for ab in links for x in ab if ab[0] != ab[1]} , links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in expected.items() if n in got} and {n for a, b in links if a != b for n in (a, b)} == set(got)


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard(docs, rows, empty, k, percent):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", _low(r[1]))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = _components(range(len(rows)), links)
    least = {}
    for i, c in comp.items():
        ids = [rows[j][0] for j in comp if comp[j] == c and rows[j][0] is not None]
        least[i] = min(ids) if sets[i] else rows[i][0]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, k, percent).collect())
    assert got == collections.Counter((rows[i][0], len(sets[i]), least[i]) for i in range(len(rows)))
    assert jaccard_join.jaccard_components(empty, k, percent).count() == 0


def test_signature_trees_lose_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**48, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(200, 300)], rng.integers(0, 2**48, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(150)]
    sets.sort(key=len)
    size = np.array([len(s) for s in sets])
    found = {(i, j) for a, b in jaccard_join.candidates(size, [jaccard_join.bitmap(s, 2) for s in sets], 85) for i, j in zip(a.tolist(), b.tolist())}
    true = {(i, j) for i in range(150) for j in range(i + 1, 150) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert true and true <= found


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_decontamination(spark, docs, rows, empty, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "FILTER_MOST", most)
    long = [r[1] for r in rows if r[1] and len(r[1].split()) > 100]
    items = [(1, " ".join(long[0].split()[10:31])), (2, long[1].upper()), (3, "abc"), (4, None), (5, ""), (6, " ".join(long[2].split()[5:9])), (7, "no such words at all"), (1, " ".join(long[0].split()[10:31]))]
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(word, _low(t))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(i))
    expected = collections.Counter()
    for r in rows:
        w, hit, ids = re.findall(word, _low(r[1])), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    ids |= windows[tuple(w[j : j + n])]
        expected[(r[0], len(w), len(hit), tuple(sorted(ids)))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert any(k[2] for k in expected)
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, bench).collect()) == expected
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    assert {r.score for r in quality_rules.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_rules.quality(empty, labels).count() == 0


def test_rule_ensemble_learns_and_is_sparse():
    rng = np.random.default_rng(0)
    x = {n: rng.random(4000) for n in quality_rules._NAMES}
    y = ((x["s_upper"] < 0.7) & (x["s_distinct"] > 0.2)).astype(float)
    model = quality_rules.fit_rules({n: v[:3000] for n, v in x.items()}, y[:3000])
    total = np.full(1000, model.intercept)
    for w, rule in model.rules:
        held = np.ones(1000, bool)
        for c in rule:
            held &= c.holds({n: v[3000:] for n, v in x.items()})
        total += w * held
    assert ((total > 0) == (y[3000:] > 0)).mean() > 0.98 and len(model.rules) < 120


def test_mixing(docs, rows, empty):
    # one text of nearly all of a source's words can't come near its target in whole copies
    rows = [r for r in rows if len(r[1] or "") < 50_000]
    docs = docs.where("text is null or length(text) < 50000")
    out = mixing.mix(docs).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    assert collections.Counter((r.doc_id, r.size) for r in out) == collections.Counter((r[0], s) for r, s in zip(rows, size))
    totals = collections.Counter()
    for r, s in zip(rows, size):
        totals[r[3]] += s
    order = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = sum(totals.values()) - sum(3 * totals[s] for s in capped)
        level = rest / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * level > 3 * totals[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * totals[s] if s in capped else weight[s] * level for s in order}
    taken = collections.Counter()
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        taken[(round(r.target, 6), r.source_size)] += r.taken
    assert set(taken) == {(round(t, 6), totals[s]) for s, t in target.items()}
    assert all(abs(words - t) <= 0.02 * t + 10 for (t, _), words in taken.items())
    assert collections.Counter(map(tuple, out)) == collections.Counter(map(tuple, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0


def test_secrets(spark, docs, empty):
    texts = ['token = "abcdefghijkl" x', "password=token:abcdefghijklm", "é😀 AKIA" + "A" * 14, "deadbeef" * 2 + " API_KEY:'" + "a1" * 8 + "'", None, "", "passwd=short secret: abcdefghijklmnop", "AKIAAKIA", "0123456789abcdeg"]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    out = {r.doc_id: r for r in secret_scan.scan(given).collect()}
    found = 0
    for r in given.collect():
        t = r.text or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(secret_scan.ASSIGN.replace("(?i)", "(?ai)"), t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        joined = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert out[r.doc_id].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (out[r.doc_id].n_assign, out[r.doc_id].n_access, out[r.doc_id].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        found += len(spans)
    assert found >= 5 and secret_scan.scan(empty).count() == 0
    clean = {r.doc_id: r.text for r in secret_scan.redact(given).collect()}
    assert clean[1000] == '[SECRET]" x' and clean[1002] == "é😀 [SECRET]" and clean[1004] is None and clean[1001] == texts[1]


def test_token_counts(docs, rows, empty, tmp_path):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    data, library, cache = open(path, "rb").read(), Tokenizer.from_file(path), f"file://{tmp_path}/cache"
    expected = collections.Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False))) for r in rows)
    for _ in range(2):  # the second time from the cache
        got = token_counts.token_counts(docs, data, "json", cache=cache).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    stored = docs.sparkSession.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in rows})
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(docs.limit(20), open(path, "rb").read(), "model").collect()
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r.n_tokens == len(pieces.encode(text[r.doc_id])) for r in got if r.doc_id is not None)
    assert token_counts.token_counts(empty, data).count() == 0


def test_special_strings_are_counted_as_the_library_does(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "a<|endoftext|>b <|endoftext|>"
    got = token_counts.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), open(path, "rb").read()).first()
    assert got.n_tokens == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False))


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\n", "<p>é"), (2, None, None), (3, "x", ""), (5, "y", "<p>é"), (4, "z", "long " * 100_000), (4, "z", "long " * 100_000), (None, "n", "<p>é"), (9, "q", "single\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, sha string")
    got = warc.round_trip(spark, df, folder=f"file://{tmp_path}/w").collect()
    expected = []
    for p, _, h in pages:
        b = (h or "").encode()
        first = min(q for q, _, g in pages if (g or "").encode() == b and q is not None)
        expected.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if p == first else "revisit", None if p == first else first))
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == collections.Counter(expected)
    assert all(r.digests_ok for r in got)
    assert warc.round_trip(spark, df.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(spark, df, least_bytes=10**9).collect()} == {"response"}


def test_warc_reader_refuses_damage():
    import io
    import zlib

    def packed(data):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    one = warc.record("response", "1", "u", b"payload" * 1000, None)
    two = list(warc.read_records(io.BytesIO(packed(one) + packed(one)), chunk=7))
    assert len(two) == 2 and all(r["block_ok"] and r["block"].endswith(b"payload") for r in two)
    assert not next(warc.read_records(io.BytesIO(packed(one.replace(b"payloadpayload", b"payloadPAYLOAD", 1)))))["block_ok"]
    for bad in (packed(one)[:-20], packed(one + b"x"), packed(one[:-3])):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


def test_warc_reader_takes_any_record(spark, tmp_path):
    import gzip

    body = b"<p>chunks</p>"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nX-Long: a\r\n b\r\nno colon\r\n\r\n4;x=y\r\n<p>c\r\n9\r\nhunks</p>\r\n0\r\n\r\n"
    plain = b"HTTP/1.0 200 OK\r\n\r\n" + body
    http = "Content-Type: application/http; msgtype="
    sha256 = f"WARC-Payload-Digest: sha-256:{hashlib.sha256(body).hexdigest()}"
    wrong = f"WARC-Payload-Digest: sha1:{warc.digest(b'other')}"
    cases = [  # kind, further headers, block; payload, payload_bytes, digests_ok
        ("warcinfo", ["Content-Type: application/warc-fields"], b"software: x\r\n", None, None, True),
        ("request", [f"{http}request"], b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", None, 0, True),
        ("response", [f"{http}response", sha256], chunked, body, len(body), True),
        ("response", [f"{http}response", f"WARC-Payload-Digest: md5:{hashlib.md5(body).hexdigest()}", "X-Folded: a", " b: c"], plain, body, len(body), True),
        ("response", [f"{http}response", wrong], plain, body, len(body), False),
        ("response", [f"{http}response", wrong, "WARC-Truncated: length"], plain, body, len(body), True),
        ("response", ["Content-Type: text/dns", "WARC-Block-Digest: unknown:1"], b"h. 1 IN A 1.2.3.4", None, None, True),
        ("revisit", [f"{http}response"], b"HTTP/1.1 304 Not Modified\r\n\r\n", None, None, True),
        ("revisit", [f"{http}response"], b"", None, None, True),
        ("resource", ["Content-Type: text/plain", sha256], body, None, len(body), True),
        ("metadata", [], b"", None, None, True),
    ]
    data = b"".join(gzip.compress("\r\n".join(["WARC/1.0", f"WARC-Type: {k}", *h, f"content-length: {len(b)}"]).encode() + b"\r\n\r\n" + b + b"\r\n\r\n") for k, h, b, *_ in cases)
    (tmp_path / "any.warc.gz").write_bytes(data)
    got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/any.warc.gz",)], "path string")).collect()
    assert [(r.record_type, r.payload and bytes(r.payload), r.payload_bytes, r.digests_ok) for r in got] == [(k, *rest) for k, _, _, *rest in cases]


def test_warc_archives_of_lost_attempts_are_not_listed(spark, tmp_path):
    import os

    rows = warc.with_revisits(spark.createDataFrame([(i, "u", f"page {i}") for i in range(50)], "page_id long, url string, html string"))
    folder = f"file://{tmp_path}/w"
    listed = [warc.write_archives(rows, folder) for _ in range(2)]
    paths = [{r.path for r in t.collect()} for t in listed]
    assert not paths[0] & paths[1] and len(os.listdir(f"{tmp_path}/w")) == len(paths[0] | paths[1])
    for table in listed:
        assert sorted(r.record_id for r in warc.read_archives(table).collect()) == sorted(f"<urn:page:{i}>" for i in range(50))


def test_html(spark):
    note = "<div class=info>the same note</div>"
    pages = [(i, "http://h/%d" % i, f"<body><nav>menu</nav><div class=post><h1>T{i} &amp; x</h1><p>one\n two<br>three<p>four {i}</div>{note}<form>f</form>") for i in range(6)]
    pages += [(10, None, None), (11, "http://g/", ""), (12, "http://g/", "<header>h</header><article><p>a<ul><li>b<li>c</ul><script>x</script><div class='reader-comments'>no</div></article><footer>z"), (12, "http://g/", "<p>&lt;b&gt; &eacute;&#33;")]
    df = spark.createDataFrame([(*p, "c", "c") for p in pages], "page_id long, url string, html string, host string, row string")
    got = collections.Counter((r.page_id, r.text) for r in site_tree.extract(df).collect())
    expected = collections.Counter([(i, f"T{i} & x\none two three\nfour {i}") for i in range(6)] + [(10, ""), (11, ""), (12, "a\nb\nc"), (12, "<b> é!")])
    assert got == expected
    assert all(r.n_chars == len(r.text) for r in site_tree.extract(df).collect()) and site_tree.extract(df.limit(0)).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 30)
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((40, 16))
    x = [(centers[i % 40] + 0.1 * rng.standard_normal(16)).astype(np.float32).tolist() for i in range(400)]
    rows = [(i, v, i % 40 % 3) for i, v in enumerate(x)] + [(500 + i, x[0], 0) for i in range(50)]
    rows += [(600, None, 0), (601, [0.0] * 16, 0), (602, x[0], None), (603, [float("nan")] * 16, 0), (604, [None] * 16, 0), (605, [], 0), (606, x[0][:8], 0), (0, x[0], 0), (None, x[1], 1)]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "vec_id long, embedding array<float>, label int, rid string, code string")
    good = [i for i, (_, v, l) in enumerate(rows) if v and l is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in good}
    links = [(i, j) for i in good for j in good if j < i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    out = embedding_dedup.near_duplicates(df, 0.93).collect()
    assert len(out) == len(rows)
    count = collections.Counter(k for ab in links for k in ab)
    got, true = sum(r.n_links for r in out), sum(count.values())
    assert 0.9 * true <= got <= true
    alone = {r.vec_id: r for r in out if r.vec_id is not None and r.vec_id >= 600}
    assert all(r.n_links == 0 and r.component_id == i and r.kept for i, r in alone.items())
    assert embedding_dedup.near_duplicates(df.limit(0), 0.93).count() == 0


def test_substrings(docs, rows, empty):
    out = substring_dedup.repeated_passages(docs).collect()
    words = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", _low(r[1])) for r in rows}
    where = collections.defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 49):
            where[tuple(w[j : j + 50])].add(i)
    shared = {i for s in where.values() if len(s) > 1 for i in s}
    assert shared and shared <= {r.doc_id for r in out} | {r.partner_id for r in out}
    for r in out:
        a, b = words[r.doc_id][r.start : r.end], words[r.partner_id][r.partner_start : r.partner_end]
        assert r.matched <= min(len(a), len(b)) and r.matched >= 0.8 * max(len(a), len(b)) and (r.kind == "copy") <= (a == b)
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_chains_follow_both_orders():
    at, to = [0, 10, 20, 30, 40, 400], [100, 110, 5, 131, 140, 500]
    best = substring_dedup.chains(at, to)[0]
    assert best == [0, 1, 3, 4]


def test_hot_seeds_give_the_same_passages(docs, monkeypatch):
    plain = sorted(map(str, substring_dedup.repeated_passages(docs).collect()))
    monkeypatch.setattr(skew, "LEAST_ROWS", 1)
    monkeypatch.setattr(skew, "HOT_PARTS", 10**6)
    assert sorted(map(str, substring_dedup.repeated_passages(docs).collect())) == plain


def _two_documents(spark, a, b):
    rows = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    found = substring_dedup.repeated_passages(rows).collect()
    return sorted((r.start, r.end, r.partner_start, r.partner_end) if r.doc_id == 1 else (r.partner_start, r.partner_end, r.start, r.end) for r in found)


def test_passages_around_different_text_are_both_found(spark):
    own = iter(f"u{i}" for i in range(10_000))

    def fresh(n):
        return [next(own) for _ in range(n)]

    head, foot = fresh(60), fresh(60)
    assert _two_documents(spark, head + fresh(60) + foot, head + fresh(60) + foot) == [(0, 60, 0, 60), (120, 180, 120, 180)]
    assert _two_documents(spark, head + fresh(60) + foot, head + fresh(90) + foot) == [(0, 60, 0, 60), (120, 180, 150, 210)]
    assert _two_documents(spark, head + fresh(20) + foot, head + fresh(20) + foot) == [(0, 140, 0, 140)]


def test_fuzzy_passages_are_found(spark):
    rng = random.Random(8)
    rows, n = [], 60
    for i in range(n):
        own = iter(f"d{i}x{j}" for j in range(1000))
        passage = [next(own) for _ in range(50)]
        changed = list(passage)
        for j in rng.sample(range(1, 49), 8):
            changed[j] = next(own)
        for k, words in enumerate((passage, changed)):
            rows.append((2 * i + k, " ".join([next(own) for _ in range(80)] + words + [next(own) for _ in range(80)])))
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.doc_id // 2 for r in out if r.doc_id // 2 == r.partner_id // 2}) >= 0.95 * n


def test_passage_made_of_pieces_of_earlier_documents_is_found(spark):
    own = iter(f"v{i}" for i in range(10**6))

    def fresh(n):
        return [next(own) for _ in range(n)]

    earlier, later, n = [], [], 50
    for _ in range(n):
        passage = fresh(66)  # the earlier documents' pieces of 39 words overlap by 12
        earlier += [fresh(30) + p + fresh(30) for p in (passage[:39], passage[27:])]
        later += [fresh(30) + passage + fresh(30) for _ in range(2)]
    rows = [(i, " ".join(w)) for i, w in enumerate(earlier + later)]
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.doc_id for r in out if r.doc_id == r.partner_id + 1 >= 2 * n and r.doc_id % 2}) >= 0.9 * n


def test_forest_keeps_the_links_of_a_large_group():
    rng = np.random.default_rng(0)
    n, group = 30_000, 10_000
    x = np.concatenate([rng.standard_normal((1, 64)) + 0.25 * rng.standard_normal((group, 64)), rng.standard_normal((n - group, 64))])
    x = embedding_dedup.unit_rows(x)
    forest = embedding_dedup.fit_forest(x[rng.choice(n, 20_000, replace=False)], 7, 0.93)
    a, b = rng.integers(0, group, (2, 3000))
    near = (a != b) & ((x[a] * x[b]).sum(axis=1) >= 0.93)
    leaves = []
    for rows in (a[near], b[near]):
        row, code = embedding_dedup.route(forest, x[rows])
        leaves.append(set(zip(row.tolist(), code.tolist())))
    assert near.sum() > 1000 and len({row for row, _ in leaves[0] & leaves[1]}) >= 0.98 * near.sum()


def test_html_of_copies_keeps_its_text(spark):
    pages = [(i, "http://h/%d" % i, f"<div class=post><p>main text {i % 2}</div>", "h") for i in range(100)]
    pages += [(200 + i, "http://one/", "<div class=post><p>the same</div>", "one") for i in range(4)]
    out = site_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string, c string")).collect()
    assert {r.page_id: r.text for r in out} == {i: f"main text {i % 2}" for i in range(100)} | {200 + i: "the same" for i in range(4)}


def test_html_words_of_classes_do_not_take_text_alone(spark):
    cases = {
        "<article><p class='share price'>The share price rose.</p><p class='ad-label'>Buy!</p><div class='share price'>x</div></article>": "The share price rose.",
        "<article><p id='related work'>Others found it.</p></article>": "Others found it.",
        "<nav>menu</nav><main><div id='widget'><p>All text.<form>f</form></div></main><div class=ad>ad</div>": "All text.",
        "<main><p>text</p><div id='widget'>w</div></main>": "text",
        "<article class=teaser>Read this</article><div class=content><p>The real text of the page.</p><div class=ad>x</div></div><p>end": "The real text of the page.",
        "<div class=content><article>Short</article><p>much longer text outside</div>": "Short",
        "<div class=ad><p>nothing else</p></div>": "",
    }
    df = spark.createDataFrame([(i, f"http://h{i}/", h) for i, h in enumerate(cases)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in site_tree.extract(df).collect()} == dict(enumerate(cases.values()))


def test_html_notice_inside_every_article_is_removed(spark):
    pages = [(i, f"http://h/{i}", f"<article><p>text {i}<p>the site's notice<p>more {i}</article>") for i in range(6)]
    out = site_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: f"text {i}\nmore {i}" for i in range(6)}


def test_html_long_paths_and_names_stay_apart():
    deep = "<div class=level>" * 60 + "<p>x"
    paths = [site_tree.parse(f"<div class='{c}'>{deep}")[0][0][0] for c in ("one", "two")]
    assert paths[0] != paths[1] and all(len(p) < 500 for p in paths)
    names = [site_tree.parse(f"<div class='a b c {c}'>x")[0][0][0] for c in ("d", "e")]
    assert names[0] != names[1]


def test_html_long_layouts_stay_apart(spark):
    rows = [(i, "http://h/", "<div class=post>own text" + "<p>x</p>" * 300 + tail + "</div>") for i, tail in enumerate(("<p>y</p>", "<pre>y</pre>"))]
    parsed = site_tree._parsed(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len({l.digest for r in parsed for l in r.layout if l.path == "/div.post"}) == len(parsed)


def test_no_chain_that_can_be_aligned_is_passed_over():
    rng = np.random.default_rng(4)
    a, oa, at, to, b, ob = [], [0], [], [], [], [0]
    for i in range(400):
        x, y = rng.integers(0, 2**32, (2, rng.integers(45, 125))).astype("<u4")
        y = y[: rng.integers(45, len(y) + 1)]
        n = min(len(x), len(y))
        same = rng.random(n) < rng.choice([0.02, 0.6, 0.85])
        y[:n][same] = x[:n][same]
        place = int(rng.integers(0, n - 5))
        y[place : place + 5] = x[place : place + 5]
        a.append(x), b.append(y), oa.append(oa[-1] + len(x)), ob.append(ob[-1] + len(y)), at.append(place), to.append(place)
    gone = substring_dedup._hopeless(np.concatenate(a), np.array(oa), np.concatenate(b), np.array(ob), np.array(at), np.array(to), np.arange(401), 32)
    found = [bool(substring_dedup.align(x, y, [i], [j], 40, 0.8)) for x, y, i, j in zip(a, b, at, to)]
    assert gone.sum() > 50 and sum(found) > 50 and not any(g and f for g, f in zip(gone, found))


def test_straight_chains_align_the_same_many_at_once():
    rng = np.random.default_rng(7)
    a, b, at, to, first = [], [], [], [], [0]
    for i in range(400):
        n, m = rng.integers(8, 180, 2)
        x, y = rng.integers(0, 9 if i % 3 else 10**6, n).astype(np.uint32), rng.integers(0, 9 if i % 3 else 10**6, m).astype(np.uint32)
        p, q = int(rng.integers(0, n - 5)), int(rng.integers(0, m - 5))
        own = min(p, q, 70) if i % 2 else 0
        k = min(n - p, m - q) + own
        y[q - own : q - own + k] = np.where(rng.random(k) < 0.12, y[q - own : q - own + k], x[p - own : p - own + k])
        last = int(rng.integers(0, k - own - 4))
        at.append([p, p + last] if last else [p])
        to.append([q, q + last + (i % 5 == 0 and q + last + 6 <= m)] if last else [q])
        a.append(x)
        b.append(y)
        first.append(first[-1] + len(at[-1]))
    offsets = [np.append(0, np.cumsum([len(v) for v in z])) for z in (a, b)]
    chains_, found = substring_dedup._straight(np.concatenate(a), offsets[0], np.concatenate(b), offsets[1], np.concatenate(at), np.concatenate(to), np.array(first), np.arange(400), 40, 0.8)
    assert 50 < len(chains_) < 400
    for i, row in zip(chains_.tolist(), found.tolist(), strict=True):
        assert substring_dedup.align(a[i], b[i], at[i], to[i], 40, 0.8) == [tuple(row)]
    none = np.zeros(0, np.int64)
    assert [len(v) for v in substring_dedup._straight(np.concatenate(a), offsets[0], np.concatenate(b), offsets[1], np.concatenate(at), np.concatenate(to), np.array(first), none, 40, 0.8)] == [0, 0]


def test_passage_whose_every_seed_stands_in_earlier_pieces_is_found(spark):
    own = iter(f"z{i}" for i in range(10**6))

    def fresh(n):
        return [next(own) for _ in range(n)]

    earlier, later, n = [], [], 20
    for i in range(n):
        passage = fresh(42)  # any 39 words of it stand in an earlier document
        earlier += [fresh(30) + passage[k : k + 39] + fresh(30) for k in range(4)]
        first = fresh(30) + passage + fresh(30)
        if i % 2:  # the first of two documents has its seeds at another place before
            first = passage[:39] + fresh(30) + passage[3:] + fresh(30) + first
        later += [first, fresh(35) + passage + fresh(25)]
    rows = [(i, " ".join(w)) for i, w in enumerate(earlier + later)]
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    words = dict(rows)
    assert {(r.doc_id, r.partner_id) for r in out} == {(i + 1, i) for i in range(4 * n, 6 * n, 2)}
    for r in out:
        assert words[r.doc_id].split()[r.start : r.end] == words[r.partner_id].split()[r.partner_start : r.partner_end] and r.matched == 42


def test_bent_chains_align_the_same_many_at_once():
    rng = np.random.default_rng(9)
    a, b, at, to, first = [], [], [], [], [0]
    for i in range(1500):
        few = 10 if i % 3 == 0 else 10**6
        p, q, gap, other = (int(v) for v in (*rng.integers(0, 70, 2), *rng.integers(-6, 30, 2)))
        n, m = max(p + 10 + gap, p + 5), max(q + 10 + other, q + 5)
        x, y = rng.integers(0, few, n + int(rng.integers(0, 80))).astype(np.uint32), rng.integers(0, few, m + int(rng.integers(0, 80))).astype(np.uint32)
        share = rng.choice([0.1, 0.7, 0.9])

        def copy(f, g, length):
            same = rng.random(length) < share
            y[g : g + length] = np.where(same, x[f : f + length], y[g : g + length])

        own, rest = min(p, q), min(len(x) - n, len(y) - m)
        copy(p - own, q - own, own)
        copy(n, m, rest)
        copy(p + 5, q + 5, max(0, min(gap, other)))
        y[q : q + 5] = x[p : p + 5]
        if gap >= 0 and other >= 0:
            y[m - 5 : m] = x[n - 5 : n]
        a.append(x), b.append(y), at.extend([p, max(p + 5 + gap, 0)]), to.extend([q, max(q + 5 + other, 0)]), first.append(len(at))
    offsets = [np.append(0, np.cumsum([len(v) for v in z])) for z in (a, b)]
    inside = [i for i in range(1500) if 0 < at[2 * i + 1] - at[2 * i] and 0 < to[2 * i + 1] - to[2 * i] and at[2 * i + 1] + 5 <= len(a[i]) and to[2 * i + 1] + 5 <= len(b[i])]
    chains_, found, none = substring_dedup._bent(np.concatenate(a), offsets[0], np.concatenate(b), offsets[1], np.array(at), np.array(to), np.array(first), np.array(inside), 40, 0.8)
    assert len(chains_) > 100 and len(none) > 100 and not set(chains_.tolist()) & set(none.tolist())
    for i, rows in [*((i, [tuple(r)]) for i, r in zip(chains_.tolist(), found.tolist(), strict=True)), *((i, []) for i in none.tolist())]:
        assert substring_dedup.align(a[i], b[i], at[2 * i : 2 * i + 2], to[2 * i : 2 * i + 2], 40, 0.8) == rows
