"""Exact top-k, phrases and conversation repair against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, phrases, registry, topk

SF = "/root/testdata/sf0.001"


def by_sql(name, *tables):
    """The oracle's rows, as text, over the driver's tables."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    return names, sorted(map(str, found.fetchall()))


# --- op12

LARGE = 1 << 63


def whole(v):
    """A vector's whole numbers as longs; None where it takes no part."""
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [max(-LARGE, min(math.floor(256 * x), LARGE - 1)) if abs(x) < 1e300 else (LARGE - 1 if x > 0 else -LARGE) for x in v]


def nearest(rows, k):
    kept = [(i, w) for i, v in rows if (w := whole(v)) is not None]
    out = []
    for a, (i, v) in enumerate(kept):
        if i is None or i % 50:
            continue
        scores = [(-max(1 - LARGE, min(sum(x * y for x, y in zip(v, u, strict=False)), LARGE - 1)), j is None, j or 0) for b, (j, u) in enumerate(kept) if b != a]
        out += [(i, n + 1, None if null else j, -s) for n, (s, null, j) in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


def odd_vectors(n=600):
    """Ties, repeated rows and ids, null ids, other lengths, empty, null, non-finite and huge vectors."""
    r = random.Random(1)
    odd = [[1e301, -1.0], [float("nan"), 1.0], [None, 1.0], None, [], [0.5], [float("inf"), 0.0], [-1e301, 1e301]]
    rows = [(r.choice([None, *range(300)]), r.choice(odd) if r.random() < 0.1 else [r.choice([-1.0, -0.5, 0.25, 0.5, 3.0]) for _ in range(r.choice([1, 2, 3]))]) for _ in range(n)]
    return rows + [(100, [1.0, 2.0])] * 7 + [(0, [9.0])] * 3


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("score", "v", "copies", "block", "query", "rank")})


@pytest.mark.parametrize("k", [1, 5])
def test_top_k_of_odd_vectors(spark, k):
    rows = odd_vectors()
    assert sorted(str(tuple(r)) for r in topk.exact_top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, k).collect()) == nearest(rows, k)


def test_top_k_in_small_blocks(spark, monkeypatch):
    """Many blocks of queries, few bins a round and few scores at once give the same rows."""
    for name, value in (("BLOCK_QUERIES", 2), ("BIN_BITS", 3), ("SCORES_AT_ONCE", 64)):
        monkeypatch.setattr(topk, name, value)
    rows = [(i, v) for i, v in odd_vectors(120) if v is None or not any(x is not None and abs(x) > 1e9 for x in v)]
    assert sorted(str(tuple(r)) for r in topk.exact_top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()) == nearest(rows, 5)


def test_top_k_with_few_or_no_rows(spark):
    rows = [(0, [1.0]), (50, [2.0])]
    assert sorted(map(tuple, topk.exact_top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert topk.exact_top_k(vectors(spark, rows[:1]), F.col("vec_id") % 50 == 0).collect() == []
    assert topk.exact_top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).collect() == []


def test_op12_equals_sql(spark):
    names, want = by_sql("op12_exact_topk", "embeddings")
    assert sorted(str(tuple(r)) for r in registry.op12_exact_topk(spark, SF).select(*names).collect()) == want and want


# --- op11


def phrase_rows(docs, least, words, top):
    """Brute force: every phrase of every piece as a tuple of words."""
    n, f = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, words + 1) for i in range(len(w) - k + 1))
    f = {x: c for x, c in f.items() if c >= least}
    inside = collections.defaultdict(int)
    for (lang, p), c in f.items():
        for i, j in itertools.combinations(range(len(p) + 1), 2):
            if 0 < j - i < len(p):
                inside[lang, p[i:j]] = max(inside[lang, p[i:j]], c)
    out = []
    for lang in n:
        rows = []
        for (of, p), a in f.items():
            if of == lang and len(p) > 1 and inside[lang, p] < a:
                cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def odd_documents():
    r = random.Random(4)
    pieces = ["a", "B", "é", "É", "cat", "sat", " ", "x\x00y", "日本", ".", ",", "\n", "\x0b", "\t", "  ", ". ", "on the mat"]
    rows = [("".join(r.choice(pieces) + r.choice([" ", ""]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, "und"])) for _ in range(150)]
    return rows + [(None, "en"), ("", None), ("...", "fr"), ("the same row on the mat", "en"), ("the same row on the mat", "en"), ("very long text " * 30_000, "xx")]


@pytest.mark.parametrize("least,words,top,entries", [(3, 5, 2000, 1 << 19), (2, 3, 7, 40)])
def test_phrases_of_odd_documents(spark, monkeypatch, least, words, top, entries):
    """Also with tiny ranges, so that every stripe is dealt out, small slices, and ranks in parts."""
    monkeypatch.setattr(phrases, "RANGE_ENTRIES", entries)
    if entries < 100:
        monkeypatch.setattr(phrases, "STRIPE_ENTRIES", 2)
        monkeypatch.setattr(phrases, "RANK_ROWS", 10)
    rows = odd_documents() if entries > 100 else odd_documents()[:-1]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("clash") for c in ("phrase", "n", "f", "slice", "rank", "k")})
    found = sorted(tuple(r) for r in phrases.collocations(docs.repartition(5), least, words, top).collect())
    assert found == phrase_rows(rows, least, words, top) and found


def test_phrases_of_no_documents(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([("a b c", "en"), (None, None)], docs.schema)).collect() == []


def test_op11_equals_sql(spark, monkeypatch):
    names, want = by_sql("op11_phrase_collocations", "documents")
    assert sorted(str(tuple(r)) for r in registry.op11_phrase_collocations(spark, SF).select(*names).collect()) == want and want


# --- op13

SOLID = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows, faults):
    """(cost, audit) by trying every sequence of edits with up to two insertions in a gap."""
    best = None
    for edits in itertools.product(*[["".join(g) + e for g in ([], ["I"], ["I", "I"]) for e in "KRD"] for _ in rows], ["", "I", "II"]):
        audit, at, cost, shapes = "".join(edits), 0, 0, [""]
        for e in audit:
            if e == "I":
                cost, shapes = cost + 2, [s + x for s in shapes for x in "ua"]
                continue
            role, fault = rows[at][0], faults[at]
            at += 1
            if e != "D":
                if fault in ("blank", "duplicate"):
                    break
                cost += (fault == "truncated") + (2 if e == "R" else 0)
                shapes = [s + x for s in shapes for x in ("ua" if e == "R" else role[:1] or "?")]
            else:
                cost += 3
            shapes = [s for s in shapes if re.fullmatch("(s?(u?|u(au)*a?))?", s)]
        else:
            good = [s for s in shapes if re.fullmatch("(s?(ua)+)?", s)]
            if good:
                best = min(best or (cost, audit), (cost, audit))
    return best


def conversation_report(rows):
    """Rows of op13 by hand: (conv_id, turn, role, text) in, one tuple a conversation out."""
    given = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        given[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, own in given.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            solid = SOLID.findall(text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] or "?") + (b[1][:1] or "?") not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = cheapest([x[1:] for x in own], faults)
        lines, at, state = [], 0, ""
        for e in audit:
            role, text = own[at][1:] if e != "I" else ("", "")
            at += e != "I"
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if state == "u" else "user"
            state = role[:1]
            lines.append(f"{role}:{text}")
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(str, out))


def odd_conversations(n=90):
    """Null, empty and foreign roles and texts, null and repeated turns, gaps, repeated rows, a null conversation."""
    r = random.Random(9)
    texts = ["Yes.", "No", "", " \t", None, "Why?\n", "a.b", "。", "Yes."]
    rows = []
    for conv in range(n):
        for _ in range(r.randint(1, 4)):
            rows.append((conv, r.choice([None, 0, 1, 2, 3, 9]), r.choice(["user", "assistant", "system", None, "", "tool", "sage"]), r.choice(texts)))
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (7000, 1, "user", "Hi."), (7000, 1, "user", "Hi.")]


def told(df):
    return sorted(str(tuple(r)) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect())


@pytest.mark.parametrize("rows_at_once", [4096, 1])
def test_repair_of_odd_conversations(spark, monkeypatch, rows_at_once):
    """Also with segments of one row, all of which meet again."""
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", rows_at_once)
    rows = odd_conversations()
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("kind", "copies", "conv", "audit", "part", "n")})
    assert told(conversations.repair_report(conversations.damage(given))) == conversation_report(rows)
    assert conversations.repair_report(conversations.damage(given.limit(0))).collect() == []


def test_op13_equals_brute_force_where_short(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.collect()]
    short = {c for c, n in collections.Counter(r[0] for r in rows).items() if n <= 3}
    got = registry.op13_conversation_repair(spark, SF)
    assert got.count() == len({r[0] for r in rows})
    assert told(got.where(F.col("conv_id").isin(list(short)))) == conversation_report([r for r in rows if r[0] in short])


def test_long_conversation_by_segments(spark):
    """A conversation of thousands of rows over many tasks equals one pass over its facts, and its repair is legal."""
    r = random.Random(3)
    rows = [(1, t, r.choice(["user", "assistant", "assistant", "tool"]), r.choice(["Yes.", f"Number {t}.", f"cut {t}"])) for t in range(9000)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit(1))
    found = conversations.audits(given).first()
    facts, seen = "", set()
    for _, _, role, text in rows:
        facts += (role[0] if role[0] in "sua" else "x") + ("d" if (role, text) in seen else "-" if text.endswith(".") else "t")
        seen.add((role, text))
    assert (found.cost, found.audit) == conversations.closed(list(conversations.segment(facts)))
    fixed = conversations.repaired_rows(given, conversations.audits(given)).orderBy("pos").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in fixed)) and len(fixed) == sum(e != "D" for e in found.audit)


def test_audits_compare_as_strings():
    """Also where hashes hardly differ, so that equal hashes of different strings are common."""
    r = random.Random(5)
    for modulus in ((1 << 61) - 1, 7, 2):
        audits = conversations.Audits(modulus)
        nodes = [0]
        for _ in range(300):
            nodes.append(audits.add(r.choice(nodes[-40:]), r.choice("DIKR")))
        for _ in range(2000):
            a, b = r.choice(nodes), r.choice(nodes)
            assert audits.less(a, b) == (audits.text(a) < audits.text(b))
            assert audits.text(audits.ancestor(a, audits.depth[a] // 2)) == audits.text(a)[: audits.depth[a] // 2]


def test_slices_of_phrases_live_for_one_level(spark, tmp_path, monkeypatch):
    """Once the levels are counted none of their slices is left on disk, and the counts can be read all the same."""
    from tidemark.llm import phrases

    monkeypatch.setattr(phrases.tb, "shared_dir", lambda _, name: f"file://{tmp_path}/{name}")
    docs = spark.createDataFrame([("a b c. a b", "x")] * 3 + [("b c", None), (None, "x")], "text string, lang string")
    counts, of_lang = phrases.phrase_counts(docs, least=3, most_words=3)
    assert not list((tmp_path / "phrases").rglob("*.parquet"))
    assert sorted(map(tuple, counts.collect())) == [("x", "a", 6), ("x", "a b", 6), ("x", "a b c", 3), ("x", "b", 6), ("x", "b c", 3), ("x", "c", 3)]
    assert sorted(map(tuple, of_lang.collect())) == [("und", 2), ("x", 15)]
