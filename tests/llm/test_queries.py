"""The registered queries over a whole small table set, against DuckDB or brute force."""

import base64
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from larkspur.llm import queries, secret_scan

D = "/root/testdata/sf0.001"


def _rows(name):
    return pq.read_table(f"{D}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{D}/{table}.parquet'")
    expected = db.execute(queries.ORACLE_SQL[name]).fetchall()
    columns = [c[0] for c in db.description]
    got = queries.QUERIES[name](spark, D)
    assert sorted(columns) == sorted(got.columns)
    assert collections.Counter(map(tuple, got.select(*columns).collect())) == collections.Counter(expected)


def test_warc_query(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in _rows("pages")}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    out = queries.QUERIES["op1_warc"](spark, D).collect()
    assert len(out) == len(pages)
    for r in out:
        b = pages[r.page_id]
        own = first[b] == r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[b])) and r.digests_ok


def test_mix_query(spark):
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in _rows("documents")}
    out = queries.QUERIES["op2_mix"](spark, D).collect()
    assert {r.doc_id: r.size for r in out} == size and len(out) == len(size)
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    taken = collections.Counter()
    for r in out:
        taken[(r.source_size, r.target)] += r.taken
    assert sum(s for s, _ in taken) == sum(size.values())
    assert abs(sum(t for _, t in taken) - sum(size.values())) < 1e-3
    longest = max(size.values())
    assert all(abs(words - t) <= 0.01 * t + longest / 2 for (_, t), words in taken.items())


def test_quality_query(spark):
    label = {r["doc_id"]: r["quality"] for r in _rows("labels")}
    out = queries.QUERIES["op3_quality"](spark, D).collect()
    assert len(out) == len(_rows("documents"))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [(r.score, label[r.doc_id]) for r in out if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert good and bad and sum((a > b) + 0.5 * (a == b) for a in good for b in bad) >= 0.8 * len(good) * len(bad)


def test_embedding_query(spark):
    rows = _rows("embeddings")
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    out = {r.vec_id: r for r in queries.QUERIES["op6_embedding_dedup"](spark, D).collect()}
    got = np.array([out[r["vec_id"]].n_links for r in rows])
    assert len(out) == len(rows) and (got <= near.sum(axis=1)).all() and got.sum() >= 0.9 * near.sum()
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id for r in out.values())


def test_html_query(spark):
    out = queries.QUERIES["op8_site_tree"](spark, D).collect()
    assert sorted((r.page_id, r.url) for r in out) == sorted((r["page_id"], r["url"]) for r in _rows("pages"))
    assert all(r.n_chars == len(r.text) and not re.search(r"<(script|nav|div|p)\b|\n\n|[ \t]{2}|^\s|\s$", r.text) for r in out)
    assert sum(r.n_chars > 0 for r in out) >= 0.9 * len(out)


def test_token_query(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for r in _rows("documents"):
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False))
        expected[r["doc_id"]] = (len(text.encode()), n, n > 1024)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op9_token_counts"](spark, D).collect()} == expected


def test_secret_query(spark):
    patterns = [("assign", re.compile(secret_scan.ASSIGN.replace("(?i)", "(?ai)")), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    out = {r.doc_id: r for r in queries.QUERIES["op10_secret_scan"](spark, D).collect()}
    docs = _rows("documents")
    assert len(out) == len(docs)
    for r in docs:
        found = [(m.start(), i, m.end()) for i, (_, p, g, least) in enumerate(patterns) for m in p.finditer(r["text"] or "") if len(m[g]) >= least]
        joined = [f"{patterns[i][0]}:{s}:{e}" for s, i, e in sorted(found)]
        got = out[r["doc_id"]]
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(f[1] == i for f in found) for i in range(3))
        assert got.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [x for x in got.spans.split(",") if x and not x.startswith("random")] == joined


def test_substring_query(spark):
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for r in _rows("documents")}
    where = collections.defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 49):
            where[tuple(w[j : j + 50])].add(i)
    shared = {i for s in where.values() if len(s) > 1 for i in s}
    out = queries.QUERIES["op4_substring_dedup"](spark, D).collect()
    assert shared <= {r.doc_id for r in out} | {r.partner_id for r in out}
    for r in out:
        a, b = words[r.doc_id][r.start : r.end], words[r.partner_id][r.partner_start : r.partner_end]
        assert 0.8 * max(len(a), len(b)) <= r.matched <= min(len(a), len(b))
