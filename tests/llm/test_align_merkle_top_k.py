"""Cross-tokenizer alignment, the Merkle manifest and exact top-k search against brute force, on rows with missing values, ties, copies, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import alignment, merkle, top_k

pytest.importorskip("tokenizers")
import public_tokenizers as P  # noqa: E402

A, B = str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))


def texts() -> list[str | None]:
    rng = np.random.default_rng(3)
    vocabulary = ["the", "of", "Éa", "tion,", "x<|endoftext|>y", "<s>", "ñu", "don't", "日本語", "🙂🙃", "é", "12,345.6", " ", " a", "\x1c", "_v_", "f(x)="] + [f"w{i}" for i in range(60)]
    joints = [" ", " ", " ", "\n", "  ", "\n\n", " \n ", "\t", "\r\n"]
    made = ["".join(x for k in rng.integers(0, len(vocabulary), n) for x in (vocabulary[k], joints[rng.integers(0, len(joints))])) for n in (1, 2, 9, 40, 40, 300)]
    return [None, "", " ", "\n", " a", "a ", "\na\nb", "a▁b", "▁", "the the the of", "the the the of", "x" * 3000, "日" * 400, "\x00a", "a\x00 b", *made, made[3]]


def aligned(text: str | None):
    """(a ids, b ids, groups, links) from whole texts and byte ranges compared one by one."""
    tok, bytes_a, model, bytes_b = alignment._tokenizers(A, B)
    if not text:
        return [], [], [], []
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    sides = []
    for ids, names in ((a, bytes_a), (b, bytes_b)):
        at, spans = 0, []
        for i in ids:
            spans.append((at, at + len(names[i])))
            at += len(names[i])
        if b"".join(names[i] for i in ids) != (" " + text).encode():
            return [], [], [], []
        sides.append(spans)
    links, j0 = [], 0
    for i, (s, e) in enumerate(sides[0]):
        while sides[1][j0][1] <= s:
            j0 += 1
        j = j0
        while j < len(b) and sides[1][j][0] < e:
            links.append((a[i], b[j]))
            j += 1
    ends = sorted({e for _, e in sides[0]} & {e for _, e in sides[1]})
    groups = [([a[i] for i, (_, e) in enumerate(sides[0]) if p < e <= q], [b[i] for i, (_, e) in enumerate(sides[1]) if p < e <= q]) for p, q in zip([0, *ends], ends, strict=False)]
    return a, b, groups, links


def as_text(groups) -> str:
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def test_byte_names_of_tokens():
    tok, bytes_a, model, bytes_b = alignment._tokenizers(A, B)
    every = "".join(chr(c) for c in range(0x250)) + "日本🙂"
    assert b"".join(bytes_a[i] for i in tok.encode(every, add_special_tokens=False).ids) == every.encode()
    assert b"".join(bytes_b[i] for i in model.encode("a 日\x00🙂")) == " a 日\x00🙂".encode()


@pytest.mark.parametrize(("most", "sent"), [(1 << 18, 1 << 19), (5, 20), (1 << 18, 0)])
def test_alignment(spark, most, sent):
    rows = [(None if k == 5 else k, t, 1, "x", 2) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint, a string, row_id int").repartition(3)
    all_of = [aligned(t) for _, t, *_ in rows]
    n = Counter(x for *_, links in all_of for x in links)
    top: dict[int, int] = defaultdict(int)
    for (_, b), k in n.items():
        top[b] = max(top[b], k)
    want = sorted(
        (str(r[0]), len(a), len(b), len(groups), len(links), sum(n[x] == top[x[1]] for x in links), sum(n[x] for x in links), hashlib.sha256(as_text(groups).encode()).hexdigest() if groups else "")
        for r, (a, b, groups, links) in zip(rows, all_of, strict=True)
    )
    got = sorted((str(r[0]), *r[1:]) for r in alignment.align(docs, A, B, most, sent).collect())
    assert got == want
    assert any(r[1] == 0 and t for r, (_, t, *_) in zip(got, rows, strict=True)), "a text whose bytes B changes"


def test_groups_and_products(spark):
    rows = [(k, t) for k, t in enumerate(texts()) if t is None or len(t) < 500]
    found = alignment.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), A, B)
    by_doc: dict[int, list] = defaultdict(list)
    for r in sorted(found.collect()):
        by_doc[r["doc_id"]].append(r)
        assert r["start"] < r["stop"]
    for k, t in rows:
        assert [(r["a_ids"], r["b_ids"]) for r in by_doc[k]] == aligned(t)[2]
        assert not by_doc[k] or by_doc[k][-1]["stop"] == len((" " + t).encode())
    products = alignment.group_products(found)
    assert products.count() == sum(len(x) * len(y) for _, t in rows for x, y in aligned(t)[2])
    assert sorted(products.columns) == ["a_id", "b_id", "doc_id", "group_no"]


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align(none, A, B).count() == 0
    assert alignment.groups(none, A, B).count() == 0


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: tuple) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(nodes: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """(top, siblings left and right of every leaf, level by level)."""
    level, at, paths = nodes, list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        runs = [level[k : k + arity] for k in range(0, len(level), arity)]
        for k, path in enumerate(paths):
            run, place = runs[at[k] // arity], at[k] % arity
            path.append(("".join(run[:place]), "".join(run[place + 1 :])))
            at[k] //= arity
        level = [h(*run) for run in runs]
    return level[0], paths


def manifest_of(rows: list[tuple], arity: int) -> list[tuple]:
    by_lang: dict[str | None, list] = defaultdict(list)
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None and tampered else r[4]
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), leaf_of((*r[:4], text))))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    below = {}
    for lang in langs:
        by_lang[lang].sort()
        below[lang] = climbed([x[2] for x in by_lang[lang]], arity)
    root, above = climbed([below[lang][0] for lang in langs], arity)
    out = []
    for k, lang in enumerate(langs):
        for (known, doc_id, leaf, other), path in zip(by_lang[lang], below[lang][1], strict=True):
            steps = path + above[k]
            node = other
            for left, right in steps:
                node = h(left, node, right)
            out.append((str(doc_id if known else None), leaf, below[lang][0], root, h(*(x + y for x, y in steps)), node, node == root))
    return sorted(out)


def manifest_rows(n: int, langs: int) -> list[tuple]:
    rng = np.random.default_rng(n)
    rows = [(int(rng.integers(0, 3 * n)), "s" if k % 5 else None, f"l{k % langs}" if k % 11 else None, k, "Été Of\nX" * (k % 4) if k % 7 else None) for k in range(n)]
    return [*rows, *rows[: n // 4], (None, None, None, None, None), (None, "", "", 0, ""), (-3, "s", "é", 1, "T" * 20_000)][: max(n, 1)] if n < 4 else [*rows, *rows[: n // 4], *rows[:1] * 9, (None, None, None, None, None), (None, "", "", 0, ""), (-3, "s", "é", 1, "T" * 20_000)]


@pytest.mark.parametrize(("n", "langs", "arity", "per_range"), [(1, 1, 8, 10), (9, 2, 8, 4), (150, 3, 2, 9), (600, 1, 8, 31), (400, 300, 3, 25), (300, 4, 8, 10_000)])
def test_manifest(spark, n, langs, arity, per_range):
    rows = manifest_rows(n, langs)
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, row int").repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = merkle.document_leaves(docs, merkle.ascii_lower(F.col("text")), tampered)
    got = sorted((str(r[0]), *r[1:]) for r in merkle.manifest(leaves, arity, per_range).collect())
    assert got == manifest_of(rows, arity)
    if n > 100:
        assert {r[6] for r in got} == {True, False}


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert merkle.manifest(merkle.document_leaves(docs, F.col("text"), F.lit(True))).count() == 0


def test_forests_merge_in_any_order():
    rng = np.random.default_rng(1)
    sizes = {0: 70, 1: 1, 2: 9, 3: 200}
    nodes = [(t, k, bytes(rng.integers(0, 256, 32, np.uint8))) for t, n in sizes.items() for k in range(n)]
    roots = set()
    for _ in range(5):
        parts = [merkle.Forest(3) for _ in range(8)]
        for p in parts:
            p.leaves |= sizes | {merkle.ROOT: len(sizes)}
        for k in rng.permutation(len(nodes)):
            t, i, d = nodes[k]
            parts[rng.integers(0, 8)].add(t, 0, i, d)
        while len(parts) > 1:
            x, y = (parts.pop(int(rng.integers(0, len(parts)))) for _ in range(2))
            parts.append(x.merge(y))
        roots |= set(parts[0].nodes.values())
    want = climbed([climbed([d.hex() for t, _, d in nodes if t == tree], 3)[0] for tree in sizes], 3)[0]
    assert [r.hex() for r in roots] == [want]


def best_of(rows: list[tuple], every: int, k: int) -> list[tuple]:
    good = [(i, v, [math.floor(256 * x) if abs(x) < 2**53 else int(x) * 256 for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, q in good:
        if v is None or v % every:
            continue
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, c, strict=False)))), w is None, w or 0) for j, w, c in good if j != i)[:k]
        out += [(v, r + 1, None if null else w, -s) for r, (s, null, w) in enumerate(scores)]
    return sorted(out, key=str)


def vector_rows(kind: str) -> list[tuple]:
    rng = np.random.default_rng(5)
    made = [(k, [float(x) for x in np.float32(rng.normal(size=24) * 0.2)]) for k in range(120)]
    copies = [(1000 + k, made[7][1]) for k in range(60)]
    if kind == "plain":
        return made + copies
    odd = [(None, made[3][1]), (0, made[3][1]), (0, made[3][1]), (5, None), (10, []), (15, [None] * 24), (20, [float("nan")] * 24), (25, [float("inf")] + [0.0] * 23), (30, [0.5, -0.25]), (35, [9.0] * 30), (-5, made[9][1])]
    large = [(200, [1e18] * 24), (201, [-1e18, 1e7] * 12), (202, [3e30] * 24), (205, [2.0**45] * 24)]
    return made + copies + odd + (large if kind == "large" else [])


@pytest.mark.parametrize(("kind", "queries", "size", "spread"), [("plain", 1024, 2048, 8), ("plain", 4, 16, 3), ("odd", 4, 16, 2), ("large", 7, 50, 2)])
def test_top_k(spark, kind, queries, size, spread):
    rows = vector_rows(kind)
    table = spark.createDataFrame([(v, e, 1, "x") for v, e in rows], "vec_id bigint, embedding array<double>, rank int, block string").repartition(3)
    got = sorted(map(tuple, top_k.top_k(table, "vec_id", "embedding", 5, 4, 256.0, queries, size, spread).collect()), key=str)
    assert got == best_of(rows, 5, 4)


def test_bounds_hold_and_rise():
    rng = np.random.default_rng(2)
    x, y = np.floor(rng.normal(size=(40, 37)) * 60), np.floor(rng.normal(size=(50, 37)) * 60)
    exact, before = x @ y.T, np.full((40, 50), np.inf)
    for a, b in zip(top_k.statistics(x), top_k.statistics(y), strict=True):
        bound = a @ b.T
        assert (bound >= exact - 1e-6).all()
        assert bound.mean() < before.mean()
        before = bound


def test_top_k_of_nothing(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert top_k.top_k(spark.createDataFrame([], schema), "vec_id", "embedding", 50).count() == 0
    assert top_k.top_k(spark.createDataFrame([(50, [1.0])], schema), "vec_id", "embedding", 50).count() == 0
    assert top_k.top_k(spark.createDataFrame([(51, [1.0]), (52, [1.0])], schema), "vec_id", "embedding", 50).count() == 0
