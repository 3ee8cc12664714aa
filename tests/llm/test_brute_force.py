"""The classifier, decontamination and the whole pipeline against plain loops; recall of near duplicates close to the threshold."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandlake.llm import quality_model as qm
from strandlake.llm.decontam import contaminated, drop_contaminated
from strandlake.llm.near_dedup import drop_near_duplicates, near_duplicates
from strandlake.llm.pii import redact_pii
from strandlake.llm.registry import vocabulary

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(text):
    return re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


# --- statistics, one text at a time


def plain_statistics(text):
    data = (text or "").encode()
    words = [w.encode() for w in words_of(text)]
    n, chars = max(len(words), 1), max(len(text or ""), 1)
    count = lambda s: sum(c in s for c in data)
    wide = sum(1 for a, b in zip(data, data[1:]) if a == 0xC3 and 0x80 <= b < 0x9F)
    upper = sum(65 <= c <= 90 for c in data) + wide
    lines, repeated, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        own = tuple(words_of(line))
        if own:
            repeated += len(own) if own in seen else 0
            seen.add(own)
    symbols = b"#*$%&<>{}[]=+~^\\/_@"
    root = lambda x, of: (x / of) ** 0.5
    return [
        np.log1p(len(words)), np.log1p(len(data) / n), root(upper, chars), root(count(b"0123456789"), chars), root(count(symbols), chars), root(count(b"!"), chars), root(count(b"|"), chars),
        root(count(b"."), n), root(count(b","), n), root(sum(c >= 0xC0 for c in data), chars), root(repeated, n), np.log(max(len(set(words)), 1)) / np.log(max(len(words), 2)),
        np.log1p(len(words) / len(lines)), root(sum(w[-1] in symbols for w in words), n), root(sum(a == b for a, b in zip(words, words[1:])), n), np.log1p(max(map(len, words), default=0)),
    ]


TEXTS = ["", None, "a", "Hello World, hello world.\nHello World, hello world.\n\nÉté à Ünï 12!", "x" * 3000, "BUY!! NOW$$ | BUY!! NOW$$ |\n" * 20, " \n\t", "the the the\nthe the the", "漢字 \U0001f600 end."]


def test_statistics_of_single_texts():
    got = qm.statistics(pa.array(TEXTS))
    want = np.array([plain_statistics(t) for t in TEXTS])
    assert np.allclose(got, want)


def plain_scores(x, label, every):
    """The discriminant written out: densities from inverses and determinants, no cached factors."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1)
    z = (x - centre) / scale
    groups = [z[label == k] for k in (0, 1)]
    pooled = sum(((g[:, :, None] - g.mean(axis=0)[:, None]) * (g - g.mean(axis=0))[:, None, :]).sum(axis=0) for g in groups) / (len(z) - 2)
    d = z.shape[1]
    pooled = 0.8 * pooled + 0.2 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
    cov = [0.7 * np.cov(g.T) + 0.3 * pooled for g in groups]
    odds = np.log((len(groups[1]) + 1) / (len(groups[0]) + 1))

    def gap(rows):
        y = (rows - centre) / scale
        logs = []
        for g, c in zip(groups, cov, strict=True):
            e = y - g.mean(axis=0)
            logs.append(-0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e) - 0.5 * np.log(np.linalg.det(c)))
        return logs[1] - logs[0]

    sign = np.where(label == 1, 1, -1)
    t = min((1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0), key=lambda t: np.log1p(np.exp(-np.clip(sign * (gap(x) / t + odds), -500, 500))).sum())
    return 1 / (1 + np.exp(-np.clip(gap(every) / t + odds, -500, 500)))


def corpus():
    rng = random.Random(7)
    vocabulary_ = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choices(vocabulary_, k=n)).capitalize() + "."
    good = lambda n=40: "\n".join(sentence(rng.randint(5, 12)) for _ in range(n // 8))
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "NOW", "click|here", "###", rng.choice(vocabulary_)]) for _ in range(rng.randint(10, 60)))
    item = " ".join(rng.choices(vocabulary_, k=24))
    rows = [(i, good(60 + i)) for i in range(60)] + [(100 + i, bad()) for i in range(40)]
    near = lambda t, step: " ".join(("zzz" if k % step == 7 else w) for k, w in enumerate(t.split()))
    base = good(600)
    rows += [(200, base), (201, base), (202, near(base, 70)), (203, near(base, 9)), (204, near(near(base, 70), 71))]
    rows += [(210, good(80) + " " + item + " " + good(50)), (211, good(80) + " " + near(item.upper(), 12) + " and more"), (212, good(90) + " " + " ".join("zz" if k % 3 == 0 else w for k, w in enumerate(item.split())))]
    rows += [(220, good(90) + " Mail me: a.b@c-d.org or +1 (017) 555-7713, host 10.1.2.3 and 300.1.2.3. Card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32 thanks.")]
    rows += [(230, None), (231, ""), (None, good(100)), (232, good(4000)), (2, rows[2][1])]
    labels = [(i, int(not 100 <= i < 200)) for i, _ in rows if i is not None] + [(None, 1), (5, None), (6, 7), (999, 1)]
    return rows, labels, [(1, item), (2, "too short to be found"), (3, None), (4, vocabulary_[0] + " " + vocabulary_[1] + " qqq")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels, items = corpus()
    path = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def plain_quality(rows, labels):
    """Scores of all rows, from a model of the labelled ones that are not held out."""
    known = {i: q for i, q in labels if i is not None and q in (0, 1) and zlib.crc32(str(i).encode()) % 5}
    text = {}
    for i, t in rows:
        if i in known and t is not None:
            text[i] = min(text.get(i, t), t)
    nulls = {i for i, t in rows if t is None and i in known} - set(text)
    ids = sorted([*text, *nulls])
    x = np.array([plain_statistics(text.get(i)) for i in ids])
    return plain_scores(x, np.array([known[i] for i in ids]), np.array([plain_statistics(t) for _, t in rows]))


def test_quality_scores(spark, tables):
    rows, labels, _ = corpus()
    want = plain_quality(rows, labels)
    docs, label = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    got = qm.score_quality(docs, qm.fit_quality(docs, label)).collect()
    key = lambda r: (repr(r[0]), r[1])
    found = sorted(((r.doc_id, r.score) for r in got), key=key)
    for (i, a), (j, b) in zip(found, sorted(((i, float(s)) for (i, _), s in zip(rows, want, strict=True)), key=key), strict=True):
        assert i == j and a == pytest.approx(b, abs=1e-6)
    # a smaller bound, and repeated labels, are held to
    model = qm.fit_quality(docs.unionByName(docs), label.unionByName(label), 20)
    assert qm.score_quality(docs, model).count() == len(rows)


def plain_contaminated(rows, items):
    out = {}
    for d, text in rows:
        have = words_of(text)
        for i, item in items:
            own = words_of(item)
            if i is None or not own:
                continue
            width = min(20, len(own))
            need = len(own) if len(own) < 8 else -(-80 * width // 100)
            best = None
            for shift in range(-len(own) + width, len(have) - width + 1):
                lo, hi = max(0, -shift), min(len(own), len(have) - shift)
                same = [own[k] == have[shift + k] for k in range(lo, hi)]
                for k in range(len(same) - width + 1):
                    agree = sum(same[k : k + width])
                    if agree >= need and (best is None or (-agree, shift + lo + k) < best):
                        best = (-agree, shift + lo + k)
            if best:
                out.setdefault((d, i), set()).add((-best[0], width, best[1]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contamination(spark, seed):
    rng = random.Random(seed)
    few = [f"w{k}" for k in range(6)]
    many = [f"v{k}" for k in range(400)]
    items = [(n, " ".join(rng.choices(rng.choice((few, many)), k=rng.choice((3, 8, 9, 13, 14, 15, 20, 21, 40))))) for n in range(25)]
    items += [(30, None), (31, ""), (None, items[0][1]), (32, items[1][1]), (1, items[2][1])]
    rows = []
    for n in range(60):
        text = rng.choices(many, k=rng.randint(0, 40))
        own = rng.choice(items[:25])[1].split()
        for k in rng.sample(range(len(own)), rng.randint(0, max(1, len(own) // 4))):
            own[k] = rng.choice(("zz", own[k].upper()))
        cut = rng.randint(0, 3)
        at = rng.randint(0, len(text))
        rows.append((n if n % 11 else None, " ".join(text[:at] + own[cut:] + text[at:])))
    rows += [(70, None), (71, ""), (3, rows[3][1])]
    # an id that stands for two items has the matches of each
    want = plain_contaminated(rows, [(k, t) for k, (_, t) in enumerate(items)])
    found = set()
    for (d, k), sets in want.items():
        if items[k][0] is not None:
            found |= {(d, items[k][0], *s) for s in sets}
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, __bad int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in contaminated(docs, bench).select("doc_id", "item_id", "agreeing_words", "window_words", "first_word").collect()}
    assert got == found and len(found) > 20
    bad = {d for d, *_ in found if d is not None}
    assert sorted((r.doc_id for r in drop_contaminated(docs, bench).collect()), key=repr) == sorted((i for i, _ in rows if i not in bad), key=repr)


# --- the pipeline


def plain_redacted(text):
    """Only what the fixture holds, by the plain expressions."""
    spans = [("EMAIL", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("IP", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("PHONE", *m.span()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text)]
    for needle, kind in (("4111 1111 1111 1111", "CARD"), ("GB82 WEST 1234 5698 7654 32", "IBAN")):
        if needle in text:
            spans.append((kind, text.index(needle), text.index(needle) + len(needle)))
    out, at = "", 0
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        out, at = out + text[at:s] + f"[{kind}]", e
    return out + text[at:]


def test_pipeline(spark, tables):
    from tokenizers import Tokenizer

    rows, labels, items = corpus()
    scores = plain_quality(rows, labels)
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    assert not any(100 <= (i or 0) < 200 for i, _ in rows) and len(rows) > 60
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        return k if group[k] == k else root(group[k])

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    kept = {i for k, (i, _) in enumerate(rows) if i is not None and least[root(k)] == i}
    assert 200 in kept and not {201, 202, 204} & kept and 203 in kept
    rows = [(i, t) for i, t in rows if i in kept or i is None]
    bad = {d for d, _ in plain_contaminated(rows, items) if d is not None}
    assert {210, 211} <= bad and 212 not in bad
    rows = [(i, None if t is None else plain_redacted(t)) for i, t in rows if i not in bad]
    coder = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    coder.no_truncation()
    coder.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = coder.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(coder.decode(ids, skip_special_tokens=False))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, tables).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_stages_on_odd_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 as score", "2 as predicted", "3 as __kept", "4 as __bad", "5 as spans", "6 as __row", "7 as quality", "8 as rep")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, tables).columns == odd.columns, name
        assert stage(spark, odd, tables).count() <= odd.count()
        assert stage(spark, odd.limit(0), tables).count() == 0, name
        nulls = odd.selectExpr(*[f"cast(null as {t}) as `{c}`" for c, t in odd.dtypes]).limit(3)
        assert stage(spark, nulls, tables).columns == odd.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), tables).count() == 0
    twice = odd.unionByName(odd)
    assert redact_pii(twice).count() == 2 * odd.count()
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(drop_near_duplicates(twice)) == ids(drop_near_duplicates(odd))


def test_pairs_close_to_the_threshold_are_found(spark):
    """Pairs of sets with a similarity from 0.85 to 0.86: the tables miss one in ten thousand, so all of 1,200 are found."""
    rng = random.Random(11)
    rows, want = [], 0
    for n in range(1200):
        size = rng.randint(150, 400)
        a = [f"p{n}x{k}" for k in range(size)]
        # single words changed: each takes five shingles out of both
        b, k = list(a), 0
        while True:
            c = list(b)
            c[6 + 11 * k] = f"q{n}x{k}"
            x, y = shingles(" ".join(a)), shingles(" ".join(c))
            if 100 * len(x & y) < 85 * len(x | y):
                break
            b, k = c, k + 1
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        want += 1
        assert 0.85 <= len(x & y) / len(x | y) <= 0.92
        rows += [(2 * n, " ".join(a)), (2 * n + 1, " ".join(b))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    found = sum(r.component_id == r.doc_id - 1 for r in got if r.doc_id % 2)
    assert found == want
    assert all(r.component_id in (r.doc_id, r.doc_id - 1) for r in got)
