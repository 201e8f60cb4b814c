"""Jaccard join, tokenizer alignment and conversation trie against brute force, with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ferroflux.llm import alignment, jaccard, queries, trie

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- Jaccard join ---------------------------------------------------------------------------


def brute_join(docs):
    """{row: (doc_id, n, component, links)}; rows that repeat a doc_id are one node."""
    sets = []
    for _, text in docs:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for p in range(len(docs)):
        for q in range(p):
            a, b = docs[p][0], docs[q][0]
            if None not in (a, b) and sets[p] and sets[q] and 100 * len(sets[p] & sets[q]) >= 90 * len(sets[p] | sets[q]):
                links[p] += 1
                links[q] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return Counter((i, len(sets[k]), None if i is None else find(i), links[k]) for k, (i, _) in enumerate(docs))


def joined(docs):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_join(docs).collect())


def clusters(rng, groups, words=90, edits=(0, 0, 1, 2, 3)):
    """Near copies around the threshold; groups share a passage, and some drift from copy to copy."""
    passage, docs = [f"p{k}" for k in range(30)], []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)] + (passage if g % 2 else [])
        for _ in range(rng.choice([1, 2, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice(edits)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            if g % 3 == 0:
                base = copy
            docs.append((len(docs), " ".join(copy)))
    return docs


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "One  TWO"), (None, "w1 w2 w3 w4"), (905, "é ü \U0001f600 " + "x" * 5000), (906, "w1 w2 w3 w4"), (907, "w1 W2 w3 w4")]


def test_join_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "PART", 2)
    docs = clusters(random.Random(3), 30) + ODD + [(5, "w1 w2 w3 w4"), (5, None), (11, "quite other words are here"), (906, "w1 w2 w3 w4")]
    random.Random(1).shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(0).alias(c) for c in ("n", "sid", "component_id", "a.b")])
    assert joined(frame.repartition(3)) == brute_join(docs)


def test_join_of_one_passage(spark):
    """Sets that share nearly all of their shingles with hundreds of others, none of them rare."""
    rng = random.Random(8)
    base = [f"q{k}" for k in range(60)]
    docs = []
    for k in range(80):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(60)] = f"q{rng.randrange(60)}"
        docs.append((k, " ".join(w)))
    assert joined(spark.createDataFrame(docs, "doc_id long, text string")) == brute_join(docs)


def test_join_finds_links_beside_the_leader(spark):
    """In a list whose leader links with nobody, the other sets still meet."""
    shared = [f"s{k}" for k in range(12)]
    text = lambda own, n: " ".join([*shared, *[f"{own}{k}" for k in range(n)]])
    docs = [(0, text("a", 50)), (1, text("b", 50)), (2, text("b", 50) + " tail"), (3, text("c", 50)), (4, text("c", 51))]
    assert joined(spark.createDataFrame(docs, "doc_id long, text string")) == brute_join(docs)


def test_join_of_an_empty_table(spark):
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bitmaps_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64))
        y = np.union1d(x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 40)).astype(np.uint64))
        bits = []
        for s in (x, y):
            width = jaccard.bitmap_width(len(s))
            bits.append(np.packbits((np.bincount((jaccard.mix64(s) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes())
        assert jaccard.least_difference(*bits) <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 100, 101])
def test_prefixes_of_linking_sets_meet(n):
    assert jaccard.prefix_size(n) == n - math.ceil(0.9 * n - 1e-9) + 1


# --- alignment ------------------------------------------------------------------------------

A, B = None, None
if True:
    import public_tokenizers

    A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_groups(text):
    """[(A's ids, B's ids)] and links of a space and the text, by offsets; None if a side spells something else."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not brute_groups.__dict__:
        t = Tokenizer.from_file(A)
        t.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in shown]
        letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(rest)}
        brute_groups.__dict__.update(t=t, sp=sentencepiece.SentencePieceProcessor(model_file=B), a={i: bytes(letters[c] for c in w) for w, i in t.get_vocab().items() if w != "<|endoftext|>"})
    t, sp, spelled = (brute_groups.__dict__[k] for k in ("t", "sp", "a"))
    if not text:
        return None
    a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    x, y = [spelled[i] for i in a], [piece(i) for i in b]
    if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
        return None
    ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
    ex, ey = ends(x), ends(y)
    groups, links, low = [], Counter(), 0
    for high in sorted(set(ex) & set(ey)):
        groups.append(([i for i, e in zip(a, ex) if low < e <= high], [i for i, e in zip(b, ey) if low < e <= high]))
        low = high
    for i, e, p in zip(a, ex, x):
        for j, g, q in zip(b, ey, y):
            if max(e - len(p), g - len(q)) < min(e, g):
                links[i, j] += 1
    return groups, links


TEXTS = ["Hello world, it's 10.5 €!", "  two  spaces\t\tand\nlines ", "Ünïcödé ça là 日本語 \U0001f600\U0001f468‍\U0001f469", "<|endoftext|> and <s> </s>", "a▁b holds the mark", "", None, "x", " ", "\x00\x01", "é composed", "endsinspace "]


def brute_counts(rows):
    told = [(i, brute_groups(text)) for i, text in rows]
    all_links = sum((t[1] for _, t in told if t), Counter())
    best = defaultdict(int)
    for (_, b), n in all_links.items():
        best[b] = max(best[b], n)
    out = Counter()
    for i, t in told:
        if not t:
            out[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        groups, links = t
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        sizes = (sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(links.values()))
        out[i, *sizes, sum(n for p, n in links.items() if all_links[p] == best[p[1]]), sum(n * all_links[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest()] += 1
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_matches_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    letters = "abcdefgh ,.  é€日\U0001f600\n'sABC019"
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 120)))) for k in range(60)]
    rows += [(None, "no id here"), (0, "an id again"), (0, "an id again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("block", "n", "pairs")])
    got = Counter(tuple(r) for r in alignment.alignment_counts(frame.repartition(3), A, B).select(*COLUMNS).collect())
    assert got == brute_counts(rows)


def test_alignment_of_empty_tables(spark):
    for rows in ([], [(1, None), (2, "a▁b")]):
        got = alignment.alignment_counts(spark.createDataFrame(rows, "doc_id long, text string"), A, B).select(*COLUMNS).collect()
        assert sorted(map(tuple, got)) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]


def test_pieces_change_nothing(monkeypatch):
    rng = random.Random(2)
    held = alignment.Aligner(A, B)
    text = "".join(rng.choice(["word", "Émile", " ", "  ", "\n", "\t ", ", ", "don't", "\U0001f600", "12", "日本", " ", "\x1c"]) for _ in range(3000))
    whole = held.document(text)
    monkeypatch.setattr(alignment, "PIECE", 40)
    assert len(list(held.pieces(text))) > 100
    cut = held.document(text)
    assert whole[0] > 0 and cut[:3] == whole[:3] and cut[4] == whole[4] and (cut[3] == whole[3]).all()
    held.transducer.memo = {k: 0 for k in range(alignment.MEMO + 1)}  # a full table starts anew
    assert held.document(text)[4] == whole[4]


def test_groups_as_rows(spark):
    rows = [(1, "Ünïcödé words here"), (2, "a▁b"), (3, None)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).orderBy("start").collect()
    assert {r.doc_id for r in got} == {1}
    assert [(r.a_ids, r.b_ids) for r in got] == brute_groups(rows[0][1])[0]
    assert [r.start for r in got] == [0, *[r.end for r in got[:-1]]] and got[-1].end == len((" " + rows[0][1]).encode())


def test_transducer_rejects_other_bytes():
    t = alignment.Transducer([b"a", b"ab", b"c"], [b"a", b"b", b"bc"])
    assert t.run([1, 2], [0, 2]) and t.run([0], [0]) == [t.run([0], [0])[0], 0]
    for a, b in (([0, 2], [0, 1]), ([1], [0]), ([0], [0, 0]), ([], [0])):
        with pytest.raises(alignment.Diverged):
            t.run(a, b)


# --- conversations --------------------------------------------------------------------------


def brute_trie(rows, share=5, most=9):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        made[c] = turns.get(c - int(math.fmod(c, share)), [])[:h] + own[h:]
    members, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children.update(n[:-1] for n in members if n)
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
            leaves[n[:d]] += not children[n]
    digest = lambda n, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(made[c]) == len(n)))).encode()).hexdigest()
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], digest(n, m)) for n, m in members.items())


TALK = "conv_id long, turn long, role string, text string"


def tried(frame):
    return Counter(map(tuple, trie.conversation_trie(frame).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def test_trie_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for c in [*range(60), -7, -5, 10**12, 10**12 + 3]:
        n = rng.choice([1, 2, 5, 12])
        rows += [(c, None if t == 0 and c % 4 == 0 else t, rng.choice(["user", "bot", None]) if c % 3 else "user", rng.choice(["é", "b" * 40, None, ""]) if c % 3 else f"t{t % 2}") for t in range(n)]
    rows += [(77, t, "user", "long") for t in range(300)] + [(78, t, "user", "long") for t in range(295)] + [(None, 0, "user", "nobody's")]
    random.Random(1).shuffle(rows)
    monkeypatch.setattr(trie, "BLOCK", 2)
    frame = spark.createDataFrame(rows, TALK).select("*", *[F.lit("clash").alias(c) for c in ("i", "depth", "k1", "place")])
    assert tried(frame.repartition(3)) == brute_trie(rows)


def test_trie_of_one_conversation_and_of_none(spark):
    rows = [(5, 0, "user", "a"), (5, 1, "bot", "b")]
    assert tried(spark.createDataFrame(rows, TALK)) == brute_trie(rows)
    assert tried(spark.createDataFrame([(5, 3, "user", None)], TALK)) == brute_trie([(5, 3, "user", None)])
    assert not tried(spark.createDataFrame([], TALK))


def test_trie_of_copies_and_repeated_rows(spark):
    """Hundreds of equal conversations, and rows that occur twice, which are turns of their own."""
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(3)] + [(1000, 0, "user", "twice")] * 2
    assert tried(spark.createDataFrame(rows, TALK)) == brute_trie(rows)


@pytest.mark.parametrize("name", ["op11_jaccard", "op13_trie"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_alignment_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 1500]  # links by brute force are quadratic
    frame = spark.createDataFrame(short, "doc_id long, text string")
    assert Counter(tuple(r) for r in alignment.alignment_counts(frame, A, B).select(*COLUMNS).collect()) == brute_counts(short)
    told = {r.doc_id: r for r in queries.op12_alignment(spark, SF).collect()}
    assert set(told) == {i for i, _ in rows}
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in told.values())
