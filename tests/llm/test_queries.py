"""The registered queries over a whole small table, against plain versions of what they are to return."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from keyloom.llm import queries
from keyloom.llm.token_counts import Counter, pieces_of

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def rows_of(spark, name):
    return queries.queries()[name](spark, DIR).collect()


def test_op1(spark, docs):
    import public_tokenizers

    counter = Counter(pieces_of(public_tokenizers.path("piece_bpe_32k.model")))
    got = rows_of(spark, "op1_token_counts")
    assert sorted((r.doc_id, r.n_words, r.n_tokens) for r in got) == sorted((i, *counter.count([d.text or ""])[0]) for i, d in docs.items())


def test_op2(spark, docs):
    plain, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    got = {r.doc_id: r for r in rows_of(spark, "op2_token_planes")}
    assert got.keys() == docs.keys()
    for i in sorted(docs):
        ids = [*plain.encode(docs[i].text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    names = sorted(want.columns)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    got = sorted((plain(r[c] for c in names) for r in rows_of(spark, name)), key=str)
    assert got == sorted((plain(r[want.columns.index(c)] for c in names) for r in want.fetchall()), key=str)


def test_op4(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op4_quality")}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert np.mean([got[i].predicted == y for i, y in labels.items()]) > 0.9


def test_op5(spark, docs):
    clean = lambda t: re.sub(r"[^\w\x80-\U0010ffff]|_", " ", t.lower(), flags=re.ASCII).split()
    found = {(r.doc_id, r.item_id) for r in rows_of(spark, "op5_decontamination")}
    items = {r.item_id: clean(r.text or "") for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for i, d in docs.items():
        own = grams(clean(d.text or ""))
        for k, words in items.items():
            if len(words) >= 5 and grams(words) <= own:
                assert (i, k) in found  # an item held whole
            if len(grams(words) & own) < 0.3 * len(grams(words)):
                assert (i, k) not in found


def test_op6(spark, docs):
    got = rows_of(spark, "op6_repeated_passages")
    grams = lambda i, a, b: {tuple(WORD.findall((docs[i].text or "").lower())[k : k + 5]) for k in range(a, b - 4)}
    for r in got:
        x, y = grams(r.doc_id, r.start, r.end), grams(r.other_id, r.other_start, r.other_end)
        assert r.end - r.start >= 50 and len(x & y) >= 0.8 * len(x | y) - 1e-9
    covered = {}
    for r in got:
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    held = {}  # exact passages of 50 words that stand in two documents
    for i, d in docs.items():
        words = WORD.findall((d.text or "").lower())
        for k in range(len(words) - 49):
            held.setdefault(tuple(words[k : k + 50]), []).append((i, k))
    for places in held.values():
        if len({i for i, _ in places}) > 1:
            assert all(set(range(k, k + 50)) <= covered.get(i, set()) for i, k in places)


def fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op7(spark, docs):
    prints = {i: fingerprint(d.text or "") for i, d in docs.items()}
    name, changed = {i: i for i in prints}, True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if name[a] != name[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    name[a] = name[b] = min(name[a], name[b])
                    changed = True
    assert sorted(map(tuple, rows_of(spark, "op7_simhash"))) == sorted((i, f"{prints[i]:016x}", name[i]) for i in prints)


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isascii() and c.isdigit()]
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_op8(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op8_personal_data")}
    assert got.keys() == docs.keys()
    for i, d in docs.items():
        want = base_spans(d.text or "")
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | ({""} if not want else set())


def test_op10(spark, docs):
    got = rows_of(spark, "op10_sharding")
    assert sorted(r.doc_id for r in got) == sorted(docs)
    shards = {}
    for r in got:
        text = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "bytes", None) and 0 <= r.shard < 40
        shards.setdefault(r.shard, []).append(r)
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    # brute force: in the order of shard and slot, each splitter is at a row's edge nearest to its share of all bytes
    ordered = [r.size for s in sorted(shards) for r in sorted(shards[s], key=lambda r: r.slot)]
    edges, total = np.r_[0, np.cumsum(ordered)], sum(ordered)
    at = 0
    for s in range(39):
        at += sum(r.size for r in shards.get(s, []))
        nearest = min(abs(e - total * (s + 1) / 40) for e in edges.tolist())
        assert abs(at - total * (s + 1) / 40) <= max(nearest, 0.002 * total / 40) + 1e-6
    assert math.isclose(at + sum(r.size for r in shards.get(39, [])), total)
