"""Operators of the corpus subpackage against brute force, on rows with nulls, repeats and clashing columns."""

import base64
import collections
import hashlib
import itertools
import re
import string
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import decontam, suffix_dedup
from strandlake.llm.bpe import encode_documents
from strandlake.llm.compaction import CommitConflict, ShardSet, shard_documents
from strandlake.llm.elias_fano import EliasFano
from strandlake.llm.near_dedup import drop_near_duplicates, near_duplicates
from strandlake.llm.oracles import pii_sql
from strandlake.llm.pii import KINDS, find_pii, pii_digest, redact_pii
from strandlake.llm.quality_model import FEATURES, drop_low_quality, fit_quality, score_quality, statistics
from strandlake.llm.quality_rules import quality_rules
from strandlake.llm.registry import vocabulary
from strandlake.llm.sais import common_prefixes, suffix_array
from strandlake.llm.scratch import new_folder
from strandlake.llm.token_store import token_store_round_trip
from strandlake.llm.warc import WarcError, gzip_member, read_records, record, warc_round_trip

BASE = " ".join(f"word{i}" for i in range(120))
NEAR = BASE.replace("word60 ", "other ")
LONG = " ".join(f"tok{i % 977}x{i}" for i in range(20_000))
TEXTS = [
    (1, BASE), (2, NEAR), (3, BASE), (4, None), (5, ""), (6, "a b c"), (7, "A b C"), (8, " \n\t "), (9, LONG), (None, BASE),
    (10, "x" * 1500), (11, "it's <|endoftext|> Ünï'll 12 ½ 漢字 \U0001f600 İΣ"), (12, "mail a.b@c.de or 10.0.0.256 1.2.3.4 4111 1111 1111 1111 +1 (017) 555-7713"),
    (1, BASE), (13, "same line\nsame line\n" * 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, k, f"c{k}", k, None, "z") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, key int, component string, rep int, spans string, lang string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def shingles(text):
    words = re.findall(r"[^ \t-\r]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_near_duplicates(docs, empty):
    sets = [(i, shingles(t)) for i, t in TEXTS]
    parent = list(range(len(sets)))

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    want = [(i, len(s), least[root(k)], i == least[root(k)]) for k, (i, s) in enumerate(sets)]
    assert rows_of(near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    assert near_duplicates(empty).count() == 0
    assert drop_near_duplicates(docs).columns == docs.columns


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(5)
    for _ in range(150):
        t = np.tile(rng.integers(0, rng.integers(1, 5), rng.integers(1, 50)).astype(np.uint8), rng.integers(1, 4))
        b = t.tobytes()
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        lcp = common_prefixes(t, sa, len(t) - np.arange(len(t)), 1000)
        for k in range(1, len(b)):
            x, y = b[sa[k] :], b[sa[k - 1] :]
            assert lcp[k] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


@pytest.mark.parametrize(("hot", "array", "piece"), [(500, 2 << 20, 4 << 20), (0, 1000, 700), (0, 2 << 20, 1 << 20)])
def test_repeated_substrings(docs, empty, hot, array, piece, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", array)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
    data = [(i, (t or "").encode()) for i, t in TEXTS]
    seen = collections.Counter(b[k : k + 400] for _, b in data for k in range(len(b) - 399))
    want = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    assert rows_of(suffix_dedup.repeated_substrings(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert suffix_dedup.repeated_substrings(empty).count() == 0


def test_encoding_matches_the_library(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    t.no_truncation()
    want = []
    for i, text in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, t.decode(ids, skip_special_tokens=False)))
    assert rows_of(encode_documents(docs, vocabulary("word_bpe_49k.json")), "doc_id", "n_tokens", "ids", "decoded") == sorted(want, key=repr)
    assert encode_documents(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_token_store(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    at, want = 0, []
    for i, text in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows_of(token_store_round_trip(docs, vocabulary("byte_bpe_50k.json")), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_store_round_trip(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_elias_fano_select():
    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 513, 3000):
        v = np.sort(rng.integers(0, 10**7, n))
        coded, size = EliasFano.from_bytes(memoryview(EliasFano.build(v).to_bytes()))
        assert (coded.select(np.arange(n)) == v).all()
        assert size <= 64 + n * 4


@pytest.mark.parametrize("window", range(decontam.LEAST_WORDS, decontam.WINDOW + 1))
def test_masks_are_lossless(window):
    masks = decontam.MASKS if window >= decontam.LONG else decontam.SHORT_MASKS
    places = [sum(1 << (o + s) for o in m) for m in masks for s in range(window - m[-1])]
    k = window - -(-decontam.PERCENT * window // 100)
    for wrong in itertools.combinations(range(window), k):
        bits = sum(1 << p for p in wrong)
        assert any(not bits & p for p in places)


def test_contamination(spark, docs, empty):
    item = " ".join(f"q{i}" for i in range(30))
    changed = " ".join("zz" if i in (3, 9, 14, 22) else f"Q{i}" for i in range(30))
    tables = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (None, item)], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"clean words {changed} and more"), (2, "q0 q1 q2 q3"), (3, None), (4, item), (None, item)], "doc_id long, text string")
    got = decontam.contaminated(rows, tables)
    assert rows_of(got, "doc_id", "item_id", "window_words") == sorted([(1, 1, 20), (4, 1, 20), (None, 1, 20)], key=repr)
    assert {r.doc_id for r in decontam.drop_contaminated(rows, tables).collect()} == {2, 3, None}
    assert decontam.contaminated(empty, tables).count() == decontam.contaminated(docs, tables.limit(0)).count() == 0


def test_quality_model(spark, docs, empty):
    good = [(i, " ".join(f"the house {k} of {i}" for k in range(30))) for i in range(60)]
    bad = [(100 + i, " ".join(f"BUY$$$ NOW{k}!!" for k in range(30 + i))) for i in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = fit_quality(table, labels)
    scored = score_quality(table, model).collect()
    assert all((r.score >= 0.3) == (r.doc_id < 100) == bool(r.predicted) for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert drop_low_quality(docs, model).columns == docs.columns
    assert score_quality(docs, model).count() == len(TEXTS)
    assert 0 <= score_quality(docs, fit_quality(empty, labels)).first().score <= 1


def test_statistics_shape():
    import pyarrow as pa

    assert statistics(pa.array(["", None, "a b"])).shape == (3, len(FEATURES))


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "x"), (2, "http://b/ ü", "x"), (3, None, None), (4, "u", ""), (5, "u", "ü\r\n\r\n"), (5, "u", "ü\r\n\r\n"), (None, "u", "alone")]
    table = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        data, top = (h or "").encode(), best[h or ""]
        revisit = i is not None and top != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert rows_of(warc_round_trip(table), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert warc_round_trip(table.limit(0)).count() == 0


def test_damaged_warc_is_refused():
    import io

    good = record(1, "u", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None, False)
    assert len(list(read_records(io.BytesIO(gzip_member(good) * 3).read))) == 3
    for damaged in (gzip_member(good.replace(b"abc", b"abd")), gzip_member(good)[:-9]):
        with pytest.raises(WarcError):
            list(read_records(io.BytesIO(damaged).read))


def test_sharding(spark, docs, empty):
    got = shard_documents(docs.repartition(7), target_bytes=10_000).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in TEXTS), key=repr)
    assert len({(r.shard, r.position) for r in got}) == len(TEXTS)
    assert shard_documents(empty).count() == 0
    shards = ShardSet(spark, new_folder(spark, "test"))
    version = shards.append(docs)
    with pytest.raises(CommitConflict):
        shards.commit(version - 1, [])
    assert shards.read().count() == len(TEXTS)


def test_short_items_match_by_all_their_words(spark):
    words = "who wrote the old song of seas".split()
    items = {n: " ".join(words[:n]) for n in range(8)} | {9: "fin"}
    texts = [" ".join(words), "So who Wrote the old\nsong of rivers fin", "who wrote that old song of seas", "wrote the old song", "", "infinite"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = set()
    for d, text in enumerate(texts):
        have = text.lower().split()
        for i, item in items.items():
            own = item.split()
            at = next((k for k in range(len(have) - len(own) + 1) if own and have[k : k + len(own)] == own), None)
            if at is not None:
                want.add((d, i, len(own), len(own), at))
    assert {tuple(r) for r in decontam.contaminated(rows, benchmark).collect()} == want
    assert {(0, 7, 7, 7, 0), (1, 6, 6, 6, 1), (1, 9, 1, 1, 8)} <= want


def _base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 16 <= len(d) <= 19 and sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_personal_data(spark, docs, empty):
    more = ["a@b@c.d a@b.c.+x@y.z 1.2.3.4.5.6.7.8", "7 " * 5000, "1" * 3000 + "a" * 3000, "é 4111111111111111 4111 x@y.z. GB82 WEST 1234 5698 7654 32"]
    table = docs.select("doc_id", "text", "spans").unionByName(spark.createDataFrame([(100 + k, t, "s") for k, t in enumerate(more)], "doc_id long, text string, spans string"))
    want = []
    for i, t in [*TEXTS, *[(100 + k, t) for k, t in enumerate(more)]]:
        spans = _base_spans(t or "")
        want.append((i, *[sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")], hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in spans).encode()).hexdigest()))
    assert rows_of(pii_digest(table), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    assert any(s["kind"] == "iban" for r in find_pii(table).collect() for s in r["spans"])
    clean = redact_pii(docs)
    assert clean.columns == docs.columns
    assert any((r.text or "").startswith("mail [EMAIL] or 10.0.0.256 ") for r in clean.collect())
    assert pii_digest(empty).count() == 0
    assert [k.name for k in KINDS if k.base] == ["email", "ip", "card", "phone"]


def test_account_numbers_and_secrets_end_where_they_end(spark):
    texts = {
        "BE68 5390 0754 7034": ["BE68 5390 0754 7034"],
        "pay BE68 5390 0754 7034 Call me": ["BE68 5390 0754 7034"],
        "BE68539007547034 2024": ["BE68539007547034"],
        "é ES91 2100 0418 4502 0005 1332 In May": ["ES91 2100 0418 4502 0005 1332"],
        "BE68 5390 0754 7034 ES91 2100 0418 4502 0005 1332 AT61 1904 3002 3457 3201 X": ["BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201"],
        "NO93 8601 1117 947 BE68 5390 0754 7034 BE68 5390 0754 7034": ["NO93 8601 1117 947", "BE68 5390 0754 7034", "BE68 5390 0754 7034"],
        "AB13 BE68 5390 0754 7034.": ["BE68 5390 0754 7034"],
        "BE68539007547034abc": ["BE68539007547034"],
        "BE68 5390 0754 7035 Call": [],
        "BE68 5390": [],
        'TOKEN = "9233A8ECF7C5B09F" Key: "abcdefgh': ['TOKEN = "9233A8ECF7C5B09F"', 'Key: "abcdefgh'],
        'secret="' + "x" * 500 + '" b': ['secret="' + "x" * 500 + '"'],
        'secret="short"': [],
    }
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans if s["kind"] in ("iban", "secret")] for r in find_pii(table).collect()}
    for i, (text, want) in enumerate(texts.items()):
        assert [s["text"] for s in got[i]] == want, text
        assert all(text[s["start"] : s["end"]] == s["text"] for s in got[i]), text
    clean = {r.doc_id: r.text for r in redact_pii(table).collect()}
    assert clean[1] == "pay [IBAN] Call me" and clean[4] == "[IBAN] [IBAN] [IBAN] X"


def test_words_nearby_decide_weak_numbers_and_sql_agrees(spark):
    number = "555-713-7713"
    texts = {
        f"call {number}.": [f"phone_local:{number}"],
        f"hotel {number}, toll {number}": [],
        f"Tel: 555.713.7713, {'x ' * 30}{number}": ["phone_local:555.713.7713"],
        "SSN 078-05-1120": ["id_number:078-05-1120"],
        "my Social\tsocial security number 078-05-1120": ["id_number:078-05-1120"],
        "078-05-1120 alone": [],
        f"phone +1 {number}": [f"phone:+1 {number}"],
        f"phone 1.{number} 078-05-1120": [],
        # a word counts when all of it stands within 40 code points, and not when it goes on beyond them
        "mobile" + " " * 34 + number: [f"phone_local:{number}"],
        "mobile" + " " * 35 + number: [],
        "xtel" + " " * 37 + number: [],
        number + " " * 37 + "fax": [f"phone_local:{number}"],
        number + " " * 37 + "faxes": [],
        f"éè phones {number} ü {number}": [f"phone_local:{number}"] * 2,
        "ES91 2100 0418 4502 0005 1332 In May BE68 5390 0754 7034": ["iban:ES91 2100 0418 4502 0005 1332", "iban:BE68 5390 0754 7034"],
        "DE89 3704 0044 0532 0130 00 DE89370400440532013000": ["iban:DE89 3704 0044 0532 0130 00", "iban:DE89370400440532013000"],
        "BE68 5390 0754 7034 Call xxGB82 WEST 1234 5698 7654 32": ["iban:BE68 5390 0754 7034", "iban:GB82 WEST 1234 5698 7654 32"],
        "": [],
    }
    rows = [*enumerate(texts), (len(texts), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in find_pii(table).collect()}
    for i, (text, want) in enumerate(texts.items()):
        assert [f"{s['kind']}:{s['text']}" for s in got[i]] == want, text
        assert all(text[s["start"] : s["end"]] == s["text"] for s in got[i]), text
    assert {r.doc_id: r.text for r in redact_pii(table).collect()}[0] == "call [PHONE]."
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string())}))
    found = con.sql(pii_sql())
    assert rows_of(pii_digest(table), *found.columns) == sorted(found.fetchall(), key=repr)


def test_quality_rules(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in quality_rules(docs).collect()}
    for i, t in TEXTS:
        words = re.findall(r"[^ \t-\r]+", t or "")
        r = got[i, len(words)]
        grams = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {p for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^ \t-\r]", x)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered),
        )
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality_rules(empty).count() == 0


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert kept <= ids
        ids = kept
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == ids
