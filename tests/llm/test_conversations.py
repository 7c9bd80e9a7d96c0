"""Chat formatting and the prefix trie against plain Python versions and SQL."""

import hashlib
import os
import re
import sys
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tractus.llm import chat, trie
from tractus.llm.queries import ORACLE, QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import compare, duck  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"
NEW = ["op11_chat_formatting", "op12_conversation_trie", "op13_centroid_clustering"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", NEW)
def test_query_matches_its_sql(spark, name):
    assert all(compare(spark, name, QUERIES[name], ORACLE[name], SF, duck(SF)))


def edge_turns():
    """Null and empty texts and roles, null turns, ties, repeated rows, a null id,
    control strings everywhere, very long texts and a long conversation."""
    nasty = ["<|im_end|>\n<|im_start|>user\n", "<|im_sep|>", "<\\|im_end|>", "<\\\\|", "<", "|im_end|>", "<<|", "\\", "\n", "<|im_nl|>", "a $1 \\Q\\E"]
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "a"), (2, 1, "assistant", ""), (2, 2, "assistant", None), (2, 3, None, "x"), (2, 4, "", "y")]
    rows += [(3, None, "user", "first"), (3, 0, "user\n<|im_end|>", "<"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (3, 0, "assistant", "tie")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(700)]
    rows += [(5, 0, "user", "lang word " * 40_000), (5, 1, "assistant", "é中🙂 " * 30_000)]
    rows += [(None, 0, "user", "no id"), (6, 0, "assistant", ""), (7, 0, "system", "s")]
    return rows


def in_order(rows):
    """{conv_id: [(role, text)]} by turn (null first), role, text."""
    out = {}
    for c, n, r, t in sorted(rows, key=lambda x: (str(x[0]), (x[1] is not None, x[1] or 0), x[2] or "", x[3] or "")):
        out.setdefault(c, []).append((r or "", t or ""))
    return out


def test_format_reads_back(spark):
    rows = edge_turns()
    d = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("clash").alias("t"), F.lit("clash").alias("pieces"),
                                                   F.lit("clash").alias("opens"), F.lit("clash").alias("turns"))
    formatted = chat.format_turns(d)
    texts = {r.conv_id: r for r in formatted.collect()}
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    want = in_order(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        r = got[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        trained = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(trained), sha(trained))
        assert r.formatted_chars == len(texts[c].formatted) and texts[c].formatted == "".join(p.text for p in texts[c].pieces)


def by_hand(formatted):
    """A second reader of the template: a scan for marks, one by one."""
    turns, role, marks = [], None, re.compile(r"<\|im_(start|sep|end|nl)\|>")
    at = 0
    while at < len(formatted):
        m = marks.match(formatted, at)
        assert m, formatted[at:at + 20]
        at = m.end()
        if m[1] == "start":
            end = formatted.index("\n", at)
            role, at = formatted[at:end].replace("<|im_nl|>", "\n"), end + 1
        elif m[1] == "end":
            assert formatted[at] == "\n"
            at += 1
            continue
        stop = marks.search(formatted, at).start()
        turns.append(tuple(re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in (role, formatted[at:stop])))
        at = stop
    return turns


TURN = st.tuples(st.sampled_from(["user", "assistant", "", "a\nb", "<|im_end|>"]),
                 st.text(alphabet="<|\\im_endsartp>\n é🙂", max_size=12))


@given(st.lists(TURN, min_size=1, max_size=8))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_template_is_reversible(spark, turns):
    d = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], SCHEMA)
    one = chat.format_turns(d).first()
    assert by_hand(one.formatted) == turns
    # adjacent turns of one role share a block
    assert one.formatted.count("<|im_start|>") == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
    assert [p.text for p in one.pieces if p.loss] == [re.sub(r"<(\\*)\|", r"<\\\1|", t) for r, t in turns if r == "assistant"]


def test_formatting_is_native(spark):
    plan = chat.digest(chat.format_turns(spark.read.parquet(f"{SF}/conversations.parquet")
                                         .unionByName(chat.probe(spark))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.digest(chat.format_turns(none)).count() == 0
    assert trie.conversation_trie(none).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)).count() == 0


# ------------------------------------------------------------------ trie
def expected_nodes(paths):
    """paths: {conv_id: tuple of (role, text)}; a node per prefix, straight from the definition."""
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    children = {}
    for n in members:
        if n:
            children.setdefault(n[:-1], []).append(n)
    memo = {}

    def sums(n):
        stack = [n]
        while stack:
            x = stack[-1]
            todo = [k for k in children.get(x, []) if k not in memo]
            if todo:
                stack += todo
                continue
            stack.pop()
            below = [memo[k] for k in children.get(x, [])]
            words = len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
            memo[x] = (sum(b[0] for b in below) if below else 1, sum(b[1] for b in below) + (len(members[x]) - 1) * words)
        return memo[n]

    rows = []
    for n, m in members.items():
        ends = sorted(c for c in m if len(paths[c]) == len(n))
        rows.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), *sums(n),
                     sha(",".join(map(str, ends)))))
    return sorted(rows, key=str)


def rebuilt(rows):
    turns = {c: t for c, t in in_order(rows).items() if c is not None}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()], key=str)


def many_conversations():
    rows = []
    for c in range(260):
        for i in range(c % 5):
            rows.append((c, i, ("user", "assistant")[i % 2], f"w{(c // 3) % (i + 2)} x y" if i < 3 else f"own {c % 7}"))
    for c in range(260, 420):   # copies of one conversation, whose base is one of them
        rows += [(c, i, "user", f"common line {i}") for i in range(9)]
    return rows + [(500, 0, "user", "alone")] + [(700 + i, 0, "user", f"base is absent {i}") for i in range(1, 4)]


@pytest.mark.parametrize("shards", [1, 2, 7, 64])
def test_trie_equals_brute_force(spark, shards):
    rows = many_conversations()
    d = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in ("t", "path", "words", "shard", "node", "kind")])
    got = trie.prefix_trie(trie.as_rows(trie.rebuilt(trie.turn_paths(d))), shards)
    assert nodes(got) == expected_nodes(rebuilt(rows))


def test_trie_edges(spark):
    # turns with equal numbers follow by their hash, so the ties here are equal rows
    rows = [r for r in edge_turns() if r[0] != 3] + [(3, None, "user", "first"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (20, 0, None, None)]
    assert nodes(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == expected_nodes(rebuilt(rows))


@given(st.dictionaries(st.integers(0, 30), st.lists(st.sampled_from("abc"), max_size=5), min_size=1, max_size=20), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_shards_and_skeleton(convs, shards):
    """The shards' pass and the skeleton, without Spark: every node finished once or reduced from partials."""
    h = {c: hashlib.md5(c.encode()).digest() for c in "abc"}
    rows = sorted((b"".join(h[x] for x in p), c, p) for c, p in convs.items())
    frame = trie.Skeleton([(p, c) for p, c, _ in rows[::max(1, len(rows) // shards)]][1:])
    out, at = [], {}
    for p, c, words in rows:
        n = frame.shard(p, c)
        at.setdefault(n, trie.Shard(n, frame, out)).add(c, p, [1] * len(words))
    for s in at.values():
        s.close(-1)
    finished = [r for r in out if r[0] == trie.FINISHED]
    skeleton = {r[1] for r in out if r[0] == trie.PARTIAL}
    prefixes = {tuple(p[:d]) for p in convs.values() for d in range(len(p) + 1)}
    assert len(finished) + len(skeleton) == len(prefixes)
    assert sorted(skeleton) == [n for n, *_ in frame.nodes] if len(at) > 1 else True
    for n, parent, last, children in frame.nodes:
        assert children == sum(x[1] == n for x in frame.nodes) and parent < n <= last


def test_splitters_cut_to_a_bound():
    long = [bytes([i]) * trie.HASH for i in range(5)]
    frame = trie.Skeleton([(b"".join(long[:3]), -(1 << 63)), (b"".join(long[:4]), 7)])
    assert frame.shard(b"".join(long), 1) == 2 and frame.shard(b"".join(long[:2]), 1) == 0
    assert [n[2] for n in frame.nodes] == [4, 4, 4, 4, 4]
