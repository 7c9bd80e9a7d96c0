"""The operators against brute-force versions, round trips and held-out accuracy."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tractus.llm import (bytebpe, classlm, fingerprint, langid, packing, quality, secrets, simhash, substring,
                         vectorjoin)
from tractus.llm.common import crc_mod, materialize

from .frames import documents, pandas, prose, roots, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


# ------------------------------------------------------------------ 1
def test_base_spans_follow_the_patterns():
    assign = re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for t in ["PassWord = 'abcdef1'", "token:abc token=abcdefgh", "password:token:longvalue123", "api_key=\"k.k/k+k=\"",
              "AKIA AKIAB" + "C" * 20 + "d", "x" + "0a" * 12, "0a" * 11, "ſecret=abcdefgh toKen=abcdefgh", "é token = zzzzzz"]:
        want = [(m.start(), m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(secrets.base_spans(t)) == sorted(want)


def test_network_learns_unseen_shapes():
    w, y = secrets.generated_findings(1200, seed=1)
    net = secrets.CharNetwork.fresh()
    net.train(secrets.encode(w), np.array(y, float), epochs=4)
    w2, y2 = secrets.generated_findings(600, seed=2)
    assert ((net.logits(secrets.encode(w2)) > 0) == np.array(y2)).mean() > 0.95


def test_network_gradients_match_differences():
    w, y = secrets.generated_findings(12, seed=3)
    x, y, net = secrets.encode(w), np.array(y, float), secrets.CharNetwork.fresh()

    def loss():
        z = net.logits(x)
        return float((np.logaddexp(0, z) - y * z).mean())

    grads = net._gradients(x, y)
    for p, g in zip([net.embed, net.conv, net.conv_bias, net.dense, net.bias], grads):
        at = np.unravel_index(np.abs(g).argmax(), p.shape)
        old, eps = p[at], 1e-5
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert math.isclose((up - down) / (2 * eps), g[at], rel_tol=1e-3, abs_tol=1e-7)


def test_short_letter_only_and_punctuated_secrets_are_scored():
    for text, body in [("pwd: hunter2x9", "hunter2x9"), ("client credential=correcthorsebatterystaple", "correcthorsebatterystaple"),
                       ("pass: s3cr3t@w0rd! and so", "s3cr3t@w0rd!"), ("Passphrase is tango-lima-kilo.", "tango-lima-kilo"),
                       ("PIN: '48291736'", "48291736"), ("x=" + "q" * 5000, "q" * 5000)]:
        at = text.index(body)
        assert (at, at + len(body)) in secrets.candidates(text)
    for text in ["", "a: b c: d", "key " + " " * 200_000, ":" * 200_000, "=" * 200_000, "no sign here at all"]:
        assert secrets.candidates(text) == []


def test_recall_over_whole_secrets_counts_those_without_candidates(docs):
    p, y = secrets._by_secret(np.array([.2, .9, .5, .7]), np.array([1, 1, 0, 1.]), [3, 3, -1, -1], 3)
    assert sorted(p) == [0, 0, .7, .9] and y.sum() == 4
    net = secrets.fit(docs)
    fresh = secrets.generated_texts(2000, seed=99)
    found = secrets.find_batch([t for t, _, _ in fresh], net)
    hit = [any(s < e and start < z for s, z, _ in f) for f, (_, start, e) in zip(found, fresh) if e]
    false = [bool(f) for f, (_, _, e) in zip(found, fresh) if not e]
    assert np.mean(hit) >= 0.95 and np.mean(false) <= 0.15
    outside = ["my login is pwd: hunter2x9 thanks", "with client credential=correcthorsebatterystaple here", "use pass: s3cr3t@w0rd! now"]
    assert all(f and f[0][2] == "model" for f in secrets.find_batch(outside, net))
    assert not any(secrets.find_batch(["Dear all: the meeting starts at 10:30:00, see http://www.example.org/notes", "key figures: revenue grew"], net))
    for f in found:
        model = [s for s in f if s[2] == "model"]
        assert all(a[1] <= b[0] for a, b in zip(model, model[1:]))


def test_threshold_keeps_the_required_recall():
    p, y = np.linspace(0, 1, 101), np.ones(101)
    t = secrets.recall_threshold(p, y, 0.9)
    assert (p >= t).mean() >= 0.9 and (p >= t + 0.011).mean() < 0.9


def test_scan_digest_and_redaction(spark, docs, rows):
    net = secrets.fit(docs)
    for r in secrets.digest(secrets.scan(docs, net)).collect():
        base = secrets.base_spans(rows[r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[2] == k for b in base) for k in ("assign", "access", "hex"))
        assert [x for x in r.spans.split(",") if x and not x.startswith("model")] == (line.split(",") if line else [])
    found = "ok password=hunter2hunter2 end " + "0123456789abcdef01234567"
    d = documents(spark, [(1, found), (2, "clean text here"), (3, None)])
    got = {r.doc_id: r for r in secrets.redacted(d, net).collect()}
    assert got[1].text == "ok [SECRET] end [SECRET]" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "clean text here" and got[3].text is None


# ------------------------------------------------------------------ 2
@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    import tiktoken
    path = bytebpe.default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bytebpe.codec(path), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab'sreT 1.$-\n\té")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bytes_encode_as_the_reference_library_does(bpe, text):
    own, other = bpe
    ids = own.encode(text).tolist()
    assert ids == other.encode_ordinary(text)
    assert own.decode(ids) == text
    s, e = own.offsets(text, ids)
    assert all(a < b for a, b in zip(s, e)) and (not ids or (s[0] == 0 and e[-1] == len(text)))


def test_split_characters_and_frames(spark, bpe, docs, rows):
    own, other = bpe
    ids = own.encode("㐀").tolist()
    first = own.token_bytes(ids[:1])
    assert len(ids) > 1 and own.decode(ids[:1]) == "�" and "㐀".encode().startswith(first) and own.decode(ids) == "㐀"
    small = docs.limit(40)
    enc = bytebpe.encode(small, bytebpe.default_ranks())
    back = bytebpe.decode(enc, bytebpe.default_ranks())
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text or "" for r in small.collect()}
    for r in bytebpe.digest(docs, bytebpe.default_ranks()).collect():
        want = np.array(other.encode_ordinary(rows[r.doc_id]), dtype="<u4")
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


# ------------------------------------------------------------------ 3
def test_edits_and_fingerprints(docs, rows):
    order = sorted(rows)
    got = {r.doc_id: r for r in fingerprint.compare_edits(docs).collect()}
    assert len(got) == len(rows)
    for i, d in enumerate(order):
        t, n = rows[d], rows[order[(i + 1) % len(order)]]
        k = len(t) // 4
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256((t[:len(t) - k] + n[:k]).encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    same = {}
    for d in order:
        same.setdefault(rows[d], set()).add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same.values()) and len(set().union(*same.values())) == len(same)
    long = [d for d in order if len(rows[d]) > 400]
    assert np.mean([got[d].near_edited for d in long]) > 0.6 > 0.3 > np.mean([got[d].near_next for d in long])


def _share(a, b):
    """The exact share of common runs of up to three words of a line."""
    a, b = (Counter(x for p in t.split("\n") for x in re.findall(r"[^ \t\n\r\f\x0B]+(?:[ \t]+[^ \t\n\r\f\x0B]+){0,2}", p)) for t in (a, b))
    size = sum(v * v for v in a.values()) + sum(v * v for v in b.values())
    return 2 * sum(v * b[x] for x, v in a.items()) / size if size else 0.0


def test_likeness_against_the_exact_share(docs, rows):
    order = sorted(rows)
    got = {r.doc_id: r for r in fingerprint.compare_edits(docs).collect()}
    errors = []
    for i, d in enumerate(order):
        t, n = rows[d], rows[order[(i + 1) % len(order)]]
        k = len(t) // 4
        for near, other in ((got[d].near_edited, t[:len(t) - k] + n[:k]), (got[d].near_next, n)):
            if other != t:
                errors.append(near - _share(t, other))
    errors = np.array(errors)
    print(f"rmse {np.sqrt((errors ** 2).mean()):.3f}, most {np.abs(errors).max():.2f}, of {len(errors)}")
    assert np.sqrt((errors ** 2).mean()) < 0.08 and np.abs(errors).max() < 0.35


def test_likeness_of_very_long_texts(spark):
    """More equal runs than 2^16: lanes do not wrap."""
    long = ["same three words\n" * 70_000, "a b c\n" * 300_000, "x y z"]
    d = documents(spark, list(enumerate(long)))
    got = {r.doc_id: r for r in fingerprint.compare_edits(d).collect()}
    for i, t in enumerate(long):
        n, k = long[(i + 1) % 3], len(t) // 4
        assert abs(got[i].near_edited - _share(t, t[:len(t) - k] + n[:k])) < 0.1
    assert got[0].near_edited > 0.6 and got[1].near_edited > 0.9


def test_multiset_sums(spark):
    a, b, c = prose(1), prose(2), prose(3)
    d = documents(spark, [(1, f"{a}\n{b}"), (2, f"{b}\n{a}"), (3, a), (4, b), (5, f"{a}\n{b}\n{c}"), (6, c)])
    fp = materialize(fingerprint.fingerprint(d).select("doc_id", F.struct("digest", "runs", "sketch").alias("f")))
    one = {i: fp.where(f"doc_id = {i}").select(F.col("f").alias(f"f{i}")) for i in range(1, 7)}
    row = one[1].crossJoin(one[2]).crossJoin(one[3]).crossJoin(one[4]).crossJoin(one[5]).crossJoin(one[6])
    same = lambda x, y: fingerprint.text_form(x) == fingerprint.text_form(y)
    got = row.select(same(F.col("f1"), F.col("f2")).alias("order"),
                     same(fingerprint.combine(F.col("f3"), F.col("f4")), F.col("f1")).alias("insert"),
                     same(fingerprint.combine(F.col("f5"), F.col("f6"), -1), F.col("f1")).alias("delete"),
                     fingerprint.likeness(F.col("f1"), F.col("f5")).alias("part"),
                     fingerprint.likeness(F.col("f3"), F.col("f6")).alias("none")).first()
    assert got.order and got["insert"] and got["delete"] and 0.55 < got.part < 0.95 and got.none < 0.4


# ------------------------------------------------------------------ 4
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    feats = materialize(quality.features(d))
    model = quality.fit(feats, lab, crc_mod("doc_id", 4) != 2)
    got = pandas(quality.score(feats.where(crc_mod("doc_id", 4) == 2), model).join(lab, "doc_id"))
    assert ((got.score >= 0.7) == (got.quality == 1)).mean() > 0.95
    kept = quality.accepted(d, model, 0.7)
    assert kept.columns == d.columns
    low = quality.score(feats, model).where("score < 0.7").count()
    assert kept.count() + low == d.count()


def test_moments_and_shrinkage():
    r = np.random.default_rng(0)
    x = r.normal(size=(30, 6))
    c = quality.shrunk_covariance(np.cov(x.T, bias=True), 30)
    assert np.linalg.eigvalsh(c).min() > 0
    m = quality.QualityModel(np.zeros(2), np.ones(2), [np.zeros(2), np.ones(2)], [np.eye(2)] * 2, [0.0, 0.0])
    assert np.allclose(m.difference(np.array([[0.0, 0.0], [1.0, 1.0], [0.5, 0.5]])), [-1, 1, 0])


# ------------------------------------------------------------------ 5
@pytest.mark.parametrize("block, pivot_bytes", [(64, 1 << 20), (6, 1 << 20), (6, 20 * 12 * 8)])
def test_vector_join_against_brute_force(spark, monkeypatch, block, pivot_bytes):
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 12))
    x = centres[r.integers(0, 40, 900)] + r.normal(size=(900, 12)) * r.choice([0.0, 0.05, 0.3, 0.5], (900, 1))
    x[100:200] = x[:100] * r.choice([0.5, 2.0, 3.7], (100, 1))   # same directions
    monkeypatch.setattr(vectorjoin, "BLOCK", block)   # many pivots and blocks
    monkeypatch.setattr(vectorjoin, "PIVOT_BYTES", pivot_bytes)
    d = spark.createDataFrame([(int(i) * 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = pandas(vectorjoin.near_duplicates(d), "vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert got.n_links.tolist() == near.sum(1).tolist()
    assert (got.component_id // 3).tolist() == roots(900, np.argwhere(near).tolist())
    assert got.kept.tolist() == (got.vec_id == got.component_id).tolist()


def test_pivot_tree_meets_all_links_and_prunes():
    r = np.random.default_rng(8)
    centres = r.normal(size=(60, 16))
    x = centres[r.integers(0, 60, 3000)] + r.normal(size=(3000, 16)) * 0.2
    tree = vectorjoin._Tree(np.concatenate([x[:400], x[:20] * 3.0]))
    assert len(tree.start) == len(tree.tops) + 1 and tree.start[-1] == len(tree.leaves) == 420
    cell, near, top = tree.home(x)
    radius = np.full(len(tree.leaves), -np.inf)
    np.maximum.at(radius, cell, near)
    top_radius = np.full(len(tree.tops), -np.inf)
    np.maximum.at(top_radius, tree.top_of[cell], top)
    row, leaf = tree.meets(x, radius, top_radius, np.arccos(0.9))
    met = np.zeros((len(x), len(tree.leaves)), dtype=bool)
    met[row, leaf] = True
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(u @ u.T >= 0.9)
    assert met[a, cell[b]].all() and met.mean() < 0.2


# ------------------------------------------------------------------ 6
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=120), st.integers(1, 40))
def test_compact_windows(values, length):
    s, salt = np.array(values, dtype=np.uint64), substring._SALTS[0]
    h = (s ^ salt) * substring._MULTIPLIER
    h ^= h >> np.uint64(31)
    h *= salt | np.uint64(1)
    key = [(int(v) >> 24, i) for i, v in enumerate(h)]
    want = []
    for c in range(len(s)):
        a = b = c
        while a and key[a - 1] > key[c]:
            a -= 1
        while b < len(s) - 1 and key[b + 1] > key[c]:
            b += 1
        if b - a + 1 >= length:
            want.append((key[c][0], a, b))
    got = substring.compact_windows(s, salt, length)
    assert sorted(zip(*(v.tolist() for v in got))) == sorted(want)


def _passages(rows):
    sh = {i: substring.shingles(t) for i, t in rows.items()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    ids = [i for i in first.values() if len(sh[i]) >= 46]
    out = set()
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if len(np.intersect1d(sh[a], sh[b])) >= 30 and (substring.verify(sh[a], sh[b]) or substring.verify(sh[b], sh[a])):
                out.add((a, b))
    return out


def test_substring_against_brute_force(docs, rows):
    want = _passages(rows)
    got = substring.near_duplicate_spans(docs).collect()
    found = {tuple(sorted((r.doc_id, r.match_id))) for r in got if not r.exact_copy}
    assert found <= want
    ids = sorted(rows)
    at = {d: i for i, d in enumerate(ids)}
    comp = roots(len(ids), [(at[a], at[b]) for a, b in found])
    assert all(comp[at[a]] == comp[at[b]] for a, b in want)   # no link between different texts is lost
    copies = Counter(rows.values())
    assert sum(r.exact_copy for r in got) == sum(n - 1 for t, n in copies.items() if len(t.split()) >= 50)


def test_hot_passage_and_near_passages(spark):
    hot = " ".join(words(500, 60))
    near = hot.split()
    near[30] = "changed"
    rows = [(i, f"{prose(1000 + i, 80)}\n{hot}\n{prose(3000 + i, 70)}") for i in range(80)]
    rows += [(100, f"{prose(9, 60)} {' '.join(near)} {prose(8, 60)}"), (200, prose(7, 200)), (201, " ".join(words(500, 40)))]
    d = documents(spark, rows)
    spans = materialize(substring.near_duplicate_spans(d))
    got = spans.collect()
    assert {r.doc_id for r in got} | {r.match_id for r in got} == {*range(80), 100}
    cut = {r.doc_id: r.text for r in substring.cut_spans(d, spans).collect()}
    assert len(cut) == len(rows) and cut[200] == rows[81][1] and cut[201] == rows[82][1]
    # one text keeps the passage; the near one may keep its form of it besides, or be that text
    assert 1 <= sum(hot in cut[i] for i in range(80)) + (" ".join(near) in cut[100]) <= 2
    for i in range(80):   # what surrounds the passage stays
        before, after = rows[i][1].split(hot)
        assert cut[i] == rows[i][1] or cut[i].startswith(before.rstrip()[:-30]) and cut[i].endswith(after.strip()[30:])


# ------------------------------------------------------------------ 7
def test_class_model(docs, rows):
    model, vocabulary = classlm.fit(docs, crc_mod("doc_id", 5) != 1)
    got = {r.doc_id: r for r in classlm.score(docs, model, vocabulary).collect()}
    tok = {d: [*t.encode().lower().split(), b"\n"] for d, t in rows.items()}
    count = Counter()
    for d, t in tok.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            count.update(t)
    n, v = sum(count.values()), len(count)
    assert (model.train_tokens, model.distinct) == (n, v)
    room = math.log10(n + 0.5 * (v + 1))
    cls = lambda w: int(model.unit_class[0 if w == b"\n" else model.head.get(classlm.word_hash(w)) or classlm.suffix_unit(w)])
    for d, t in tok.items():
        assert got[d].n_tokens == len(t) and got[d].n_known == sum(count[w] > 0 for w in t)
        assert math.isclose(got[d].base_score, sum(math.log10(count[w] + 0.5) - room for w in t), rel_tol=1e-9)
        c = [0, *map(cls, t)]
        want = sum(model.transition[a, b] - model.log_room[b] + math.log10(count[w] + 0.5) for a, b, w in zip(c, c[1:], t))
        assert math.isclose(got[d].score, want, rel_tol=1e-9)
    # transitions are distributions; a class's words and its unseen rest are one
    assert np.allclose((10 ** model.transition).sum(1), 1)
    per = Counter()
    for w, k in count.items():
        per[cls(w)] += k + 0.5
    for k, total in per.items():
        assert math.isclose(total + 0.5, 10 ** model.log_room[k], rel_tol=1e-9)
    held = [d for d in rows if zlib.crc32(str(d).encode()) % 5 == 1]
    assert sum(got[d].score for d in held) > sum(got[d].base_score for d in held)


def test_exchange_raises_likelihood():
    r = np.random.default_rng(0)
    big = r.poisson(3, (60, 60)).astype(float) * np.kron(r.random((6, 6)) > 0.5, np.ones((10, 10)))

    def likelihood(cls):
        m = np.zeros((60, 8))
        m[np.arange(60), cls] = 1
        g = m.T @ big @ m
        return classlm._xlogx(g).sum() - classlm._xlogx(g.sum(0)).sum() - classlm._xlogx(g.sum(1)).sum()

    seen = [likelihood(classlm.exchange(big, 8, s)) for s in range(4)]
    assert seen == sorted(seen) and seen[-1] > seen[0]


# ------------------------------------------------------------------ 8
def _gray_sorted(f):
    g = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        g ^= g >> np.uint64(s)
    return f[np.argsort(g)]


@pytest.mark.parametrize("seed", range(6))
def test_gray_index(seed):
    r = np.random.default_rng(seed)
    f = r.integers(0, 2**63, 12, dtype=np.uint64)[r.integers(0, 12, 500)]
    for _ in range(seed + 2):
        f = f ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64))
    f = _gray_sorted(np.unique(f))
    n, near = len(f), np.argwhere(np.triu(np.bitwise_count(f[:, None] ^ f) <= 4, 1))
    i, j = simhash.near_pairs(f, None, 4)
    assert (np.bitwise_count(f[i] ^ f[j]) <= 4).all()
    assert roots(n, zip(i.tolist(), j.tolist())) == roots(n, near.tolist())
    k = n // 3
    links = []
    for a, b, oa, ob in ((f[:k], None, 0, 0), (f[k:], None, k, k), (f[:k], f[k:], 0, k)):
        i, j = simhash.near_pairs(a, b, 4)
        links += zip((i + oa).tolist(), (j + ob).tolist())
    assert roots(n, links) == roots(n, near.tolist())


def test_simhash_groups_of_any_size(spark):
    """Groups over the block size, cut over tasks, give the same components."""
    r = np.random.default_rng(3)
    f = np.full(400, r.integers(0, 2**63, dtype=np.uint64))
    for _ in range(5):
        f = f ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64))
    f = np.unique(np.concatenate([f, r.integers(0, 2**63, 200, dtype=np.uint64)]))
    fps = materialize(spark.createDataFrame([(int(v), i) for i, v in enumerate(f.view(np.int64))], "fp long, rep long"))
    near = np.argwhere(np.triu(np.bitwise_count(f[:, None] ^ f) <= 4, 1)).tolist()
    for rows in (16, 8192):
        links = [(x.a, x.b) for x in simhash.near_links(fps, rows=rows).collect()]
        assert roots(len(f), links) == roots(len(f), near)


def test_simhash_documents(docs, rows):
    import xxhash
    ids = sorted(rows)

    def fingerprint_of(text):
        w = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = np.array([fingerprint_of(rows[d]) for d in ids], dtype=np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(f[:, None] ^ f) <= 4, 1)).tolist()
    got = pandas(simhash.near_duplicates(docs), "doc_id")
    assert got.fp.to_numpy().view(np.uint64).tolist() == f.tolist()
    assert got.component_id.tolist() == [ids[i] for i in roots(len(ids), near)]


# ------------------------------------------------------------------ 9
def _check_packing(got, exp, capacity):
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == exp
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all()
    assert s.groupby("sequence_id").length.sum().max() <= capacity


def test_packing_documents(docs, rows):
    from tokenizers import Tokenizer
    t, exp = Tokenizer.from_file(packing.default_vocabulary()), {}
    for d, text in rows.items():
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            p = ids[at:at + 4096]
            exp[d, k] = (at, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes()))
    got = pandas(packing.pack(docs, packing.default_vocabulary()), "doc_id", "piece")
    _check_packing(got, exp, 4096)
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 4096) + 1


@pytest.mark.parametrize("text", ["Hello <|endoftext|> WORLD", "a\x1cb\x85c\xa0d", "É é É ŉ ǰ İI", "don't I'LL 12½³",
                                  "中文 Σας ΣΑΣ", "x" * 5000, "​z​", "ﬁ ß ẞ"])
def test_words_encode_as_the_library_does(text):
    from tokenizers import Tokenizer
    path = packing.default_vocabulary()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.word_tokens(path).ids(text), dtype="<u4").tolist() == want


def test_texts_of_a_slice_encode_together_as_the_library_does():
    import pyarrow as pa
    from tokenizers import Tokenizer
    path = packing.default_vocabulary()
    plain = [c for c in map(chr, range(0x20, 0x250)) if c.isprintable()]
    texts = ["", " \t\n", "".join(plain), *(f"a{c}b {c}{c} 1{c}" for c in plain), "don't I'LL 'S '", "a <|endoftext|> B",
             "İ Ⱥ Ⱦ", "a\x00b\x0bc\xadd\x7fe", "中文 The", " \r\nthe ", "x" * 3000]
    whole = Tokenizer.from_file(path)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    tokens = packing.WordTokens(path)
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.many(pa.array(texts))] == want
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.many(pa.array(["y", *texts, "z"]).slice(1, len(texts)))] == want


def test_a_slice_encodes_each_distinct_piece_once():
    import pyarrow as pa
    tokens, asked = packing.WordTokens(packing.default_vocabulary()), []

    class Asked(dict):
        def __getitem__(self, piece):
            asked.append(piece)
            return tokens._encode_piece(piece)

    tokens._piece = Asked()
    got = tokens.many(pa.array(["The cat, the cat. ", "the CAT's cat", ""] * 50))
    assert sorted(p for p in asked if p) == ["'s", ",", ".", "cat", "the"]
    assert got[:3] * 50 == got and got[2] == b""


def test_slices_by_bytes_hold_every_text_in_order():
    import pyarrow as pa
    texts = ["é" * n for n in (0, 3, 9, 1, 40, 0, 0, 2, 6)]
    got = [p.to_pylist() for p in packing._by_bytes(pa.array(["", *texts]).slice(1), 16)]
    assert sum(got, []) == texts and len(got) > 2
    assert all(sum(2 * len(t) for t in p[1:]) <= 16 for p in got)


def test_program_covers_every_piece_and_nears_the_bound():
    r = np.random.default_rng(1)
    counts = np.bincount(np.minimum(64, 1 + r.lognormal(2, 0.8, 3000).astype(int)), minlength=65)
    plan = packing.solve(counts, 64, steps=200)
    held = np.zeros(65, int)
    for pattern, m in plan:
        assert sum(pattern) <= 64 and m > 0
        for c in pattern:
            held[c] += m
    assert (held == counts).all()
    assert sum(m for _, m in plan) <= 1.01 * (counts * np.arange(65)).sum() / 64 + 1
    assert packing.solve(np.zeros(65, int), 64) == []


def test_pricing_is_optimal():
    r = np.random.default_rng(2)
    for _ in range(20):
        value = np.where(r.random(21) < 0.6, r.random(21), -np.inf)
        value[0] = -np.inf
        best = [0.0] * 21
        for c in range(1, 21):
            best[c] = max([best[c - 1], *(best[c - k] + value[k] for k in range(1, c + 1))])
        pick = packing.price(value, 20)
        assert sum(pick) <= 20 and math.isclose(sum(value[c] for c in pick), best[20], abs_tol=1e-12)


# ----------------------------------------------------------------- 10
def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d, crc_mod("doc_id", 5) != 0)
    got = pandas(langid.predict(d, model).join(d.where(crc_mod("doc_id", 5) == 0).select("doc_id", "lang"), "doc_id"))
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_counts_are_those_of_all_texts(spark):
    texts = [("en", "the cat"), ("en", "a dog"), ("de", "der hund"), (None, "zzz"), ("de", None)]
    d = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    m = langid.fit(d, F.lit(True))
    assert m.languages == ["de", "en"] and np.allclose(np.exp(m.log_prior), [1 / 3, 2 / 3])
    c = langid.bucket_counts("the cat") + langid.bucket_counts("a dog")
    assert np.allclose(m.log_prob[1], np.log((c + 0.5) / (c.sum() + 0.5 * langid.BUCKETS)))
    assert m.predict("123 !!") == ("und", 0.0)
