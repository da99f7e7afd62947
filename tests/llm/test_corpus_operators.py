"""Each operator against a brute-force version, on rows with missing values, odd white space, copies, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegauge.llm import decontamination, language_id, license_scan, line_dedup, lm_scoring, media_columns, near_copies, packing, simhash, substring_dedup, token_counts

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers as P  # noqa: E402

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, words string, key bigint, anchor bigint, stop int"


def _texts() -> list[tuple[int | None, str | None]]:
    rng = np.random.default_rng(7)
    vocabulary = ["the", "of", "Éa", "tion", "and,", "that", "x<|endoftext|>y", "ñu", "GNU", "MIT"] + [f"w{i}" for i in range(400)]

    def words(n):
        return [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]

    passage, line = " ".join(words(60)), "All rights reserved. Every line that is long enough"
    base = words(150)
    near = [*base[:70], "changed", *base[71:]]
    out: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "12 34 !!"), (None, "no id at all here " + passage), (5, passage), (6, " ".join(words(30)) + "\n" + passage + "\n" + " ".join(words(25)))]
    out += [(7, " ".join(base)), (8, " ".join(near)), (9, " ".join(base)), (10, " ".join(base).upper())]
    out += [(11, f"{line}\n{' '.join(words(12))}\n\n"), (12, f"  {line.upper()} \r\nshort\n{line}"), (13, f"a\n{line}\x0b"), (14, "Licensed under CC BY-NC 4.0.\nx cc by cc by general public license"), (15, "a  b   c  d　e▁f  "), (15, "a  b   c  d　e▁f  ")]
    out += [(16, " ".join(words(6000))), (17, passage.replace(passage.split()[30], "zzz")), (18, "w1 " * 45), (19, "▁ ▁▁x"), (20, "under the\nApache"), (21, "one two three four"), (22, "é" * 50), (23, "GNU General Public License")]
    return out


TEXTS = _texts()
BY_ID = [(i, t) for i, t in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    langs = ["en", "fr", None]
    return spark.createDataFrame([(i, t, langs[k % 3], "s", 0, 1, "x", 1, 1, 1) for k, (i, t) in enumerate(TEXTS)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(t):
    return (t or "").encode()


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_substring_dedup(docs, empty):
    got = rows(substring_dedup.substring_dedup(docs, digest=True), "doc_id", "n_words", "n_removed", "kept")
    first, want = {}, []
    order = sorted((i, t) for i, t in set(TEXTS) if i is not None)
    windows = {}
    for i, t in order:
        w = SPLIT.findall(raw(t))
        windows[i, t] = [tuple(w[k : k + 20]) for k in range(len(w) - 19)]
        for k, x in enumerate(windows[i, t]):
            first.setdefault(x, (i, k))
    for i, t in TEXTS:
        w = SPLIT.findall(raw(t))
        gone = set()
        for k, x in enumerate(windows.get((i, t), [])):
            if first[x] < (i, k):
                gone.update(range(k, k + 20))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 200
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_of_crowded_anchors(docs):
    """Anchors sent window by window, and many shards, give the same."""
    plain = rows(substring_dedup.substring_dedup(docs), "doc_id", "n_removed", "kept")
    assert rows(substring_dedup.substring_dedup(docs, hot=1, shard_words=300), "doc_id", "n_removed", "kept") == plain


def test_fm_index_finds_foreign_patterns():
    from tidegauge.llm.fm_index import FmIndex

    rng = np.random.default_rng(0)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (40, 3, 60)])
    index = FmIndex(text, 5)
    query = np.concatenate([rng.integers(1, 4, 50), text[10:30], rng.integers(1, 4, 10)])
    known = {tuple(text[k : k + 5]) for k in range(len(text) - 4)}
    found = index.stream(query, np.array([0]), np.array([len(query)]))
    assert [f >= 0 for f in found[: len(query) - 4]] == [tuple(query[k : k + 5]) in known for k in range(len(query) - 4)]
    least = index.least_of_class(np.arange(len(text)))
    assert all(tuple(text[least[f] : least[f] + 5]) == tuple(query[k : k + 5]) for k, f in enumerate(found) if f >= 0)


def _fingerprint(t):
    w = raw(t).lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, empty):
    out = simhash.simhash_components(docs)
    assert rows(out, "doc_id", "fingerprint") == sorted(((i, f"{_fingerprint(t):016x}") for i, t in TEXTS), key=repr)
    ids = sorted({i for i, _ in TEXTS if i is not None})
    fps = {i: _fingerprint(t) for i, t in TEXTS if i is not None}
    group = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    assert {r.doc_id: r.component_id for r in out.collect()} == group | {None: None}
    assert simhash.simhash_components(empty).count() == 0


def test_variants_are_never_broadcast(spark, monkeypatch):
    """Spark takes exploded rows for as few as there were before, so that a table under its threshold would be broadcast with all variants."""
    plans = []
    for module in (simhash, near_copies):
        write = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name, write=write: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    monkeypatch.setattr(near_copies, "small_enough", lambda df: df)
    pairs = simhash.links(spark.range(3000).select((F.col("id") * 3).alias("fp")))
    reps = spark.range(3000).select(F.col("id").alias("class1"), (F.col("id") * 3).alias("fp0"), F.lit(0).cast("long").alias("fp1"))
    seen = [p for name, p in plans if name == "simhash-variants"] + [x._jdf.queryExecution().executedPlan().toString() for x in (pairs, near_copies.members_of_variants(reps))]
    assert len(seen) == 3 and all("SortMergeJoin" in p and "BroadcastExchange" not in p for p in seen)


def test_links_of_crowded_variants(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for k in (1, 2, 3, 4) for _ in range(40)})
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    for hot in (2000, 3):
        assert set(map(tuple, simhash.links(df, hot).collect())) == want


def test_language_id(spark, small, docs, empty):
    table = spark.read.parquet(f"{small}/documents.parquet")
    out = language_id.language_id(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in out)
    odd = language_id.language_id(docs).collect()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {i for i, t in TEXTS if not any(c.isalpha() for c in t or "")} and len(odd) == len(TEXTS)
    assert language_id.language_id(empty).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_against_brute_force(spark):
    """Counts, posteriors and ties by plain Python, on scripts of one to four bytes a character; only the hash of an n-gram is the operator's."""
    said = [("en", "The cat sat, on 3 MATS"), ("en", "a dog's day"), ("ru", "Кот сидел на ковре"), ("ja", "猫が座った。"), ("ru", None), (None, "unlabelled words"), ("xx", "𝔘𝔫 🙂 Éa"), ("en", "")]
    train = spark.createDataFrame(said, "lang string, text string")
    asked = ["the mat", "кОТ", "猫", "𝔘", "Zebra 99", "É", "", None, "?!", "the cat " * 400, " a"]
    buckets = 1 << 12
    languages, weights = language_id.train(train, buckets=buckets)
    assert languages == ["en", "ja", "ru", "xx"]

    def folded(t):
        out = [c.lower() if c.isalpha() else " " for c in t or ""]
        return [c if len(c) == 1 else d for c, d in zip(out, t or "", strict=True)]

    def grams(t):
        f = folded(t)
        return ["".join(f[k : k + n]) for n in (1, 2, 3) for k in range(len(f) - n + 1) if set(f[k : k + n]) != {" "}]

    def bucket(gram):
        found = list(language_id.ngram_buckets(np.array([ord(c) for c in gram], np.uint32), np.array([0, len(gram)]), (len(gram),), buckets))
        return int(found[0][1][0])

    counts = {x: Counter(bucket(g) for lang, t in said if lang == x for g in grams(t)) for x in languages}
    total = {x: sum(counts[x].values()) + buckets for x in languages}
    got = language_id.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), languages, weights).collect()
    for r in got:
        t = asked[r.doc_id]
        g = grams(t)
        logs = [sum(math.log((counts[x][bucket(w)] + 1) / total[x]) for w in g) for x in languages]
        z = [math.exp(10 * (v - max(logs)) / math.sqrt(max(1, len(g)))) for v in logs]
        if any(c.isalpha() for c in t or ""):
            assert r.lang_pred == languages[int(np.argmax(z))] and math.isclose(r.score, max(z) / sum(z), rel_tol=1e-3), t
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {asked[r.doc_id]: r.lang_pred for r in got if asked[r.doc_id] in ("the mat", "кОТ", "猫", "𝔘")} == {"the mat": "en", "кОТ": "ru", "猫": "ja", "𝔘": "xx"}


def test_lm_scoring(docs, empty):
    c: Counter = Counter()
    tokens = {}
    for k, (i, t) in enumerate(TEXTS):
        tokens[k] = [*raw(t).lower().split(), None]
        if i is None or zlib.crc32(str(i).encode()) % 10:
            c.update(tokens[k])
    n, v = sum(c.values()), len(c)
    want = sorted(((i, len(tokens[k]), sum(c[x] > 0 for x in tokens[k]), n) for k, (i, _) in enumerate(TEXTS)), key=repr)
    for most, size in ((1 << 19, 1 << 26), (10, 1 << 26), (10, 0)):
        got = lm_scoring.lm_scores(docs, max_broadcast=most, max_filter=size)
        assert rows(got, "doc_id", "n_tokens", "n_known", "train_tokens") == want
        base = sorted(r.base_score for r in got.collect())
        assert np.allclose(base, sorted(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens[k]) for k in tokens))
        assert all(r.score <= 0 and math.isfinite(r.score) for r in got.collect())
    assert lm_scoring.lm_scores(empty).count() == 0


def test_language_model_holds_all_pairs(docs):
    """Scores are those of levels of the whole counts, pairs seen once too, but for what the filter finds by chance."""
    runs = [[x.lower() for x in raw(t).split()] for _, t in TEXTS]
    words, pairs = Counter(), Counter()
    for (i, _), run in zip(TEXTS, runs, strict=True):
        if i is None or zlib.crc32(str(i).encode()) % 10:
            words.update([*run, None])
            pairs.update(zip([None, *run], [*run, None], strict=True))
    mass = sum(words.values()) + 0.1 * (len(words) + 1)

    def ends(c):
        """The least and the largest count that share a level with c: half octaves of whole numbers."""
        same = [x for x in range(max(1, c // 2), 2 * c + 2) if math.floor(2 * math.log2(x) + 1e-9) == math.floor(2 * math.log2(c) + 1e-9)] if c else [0]
        return same[0], same[-1]

    def share(a, b):
        word, context = (ends(words[b])[0] + 0.1) / mass, ends(words[a])[1]
        return 0.2 * ends(pairs[a, b])[0] / context + 0.8 * word if context else word

    def score(run):
        return sum(math.log10(min(1.0, share(a, b))) for a, b in zip([None, *run], [*run, None], strict=True))

    # A context's shares, that of an unknown word included, are those of a probability.
    for a in [None, "never", *list(words)[:40]]:
        assert 0.5 < sum(share(a, b) for b in [*words, "unknown"]) <= 1 + 1e-9

    want = sorted(((len(run) + 1, score(run)) for run in runs))
    first = None
    for most, size in ((1 << 19, 1 << 26), (0, 1 << 26), (10, 0), (0, 0)):
        got = sorted((r.n_tokens, r.score) for r in lm_scoring.lm_scores(docs, max_broadcast=most, max_filter=size).collect())
        a, b = np.array(got), np.array(want)
        first = a if first is None else first
        assert np.allclose(a, first)  # the filter sent whole and probed by a shuffle
        assert (a[:, 0] == b[:, 0]).all() and np.allclose(a[:, 1].sum(), b[:, 1].sum(), rtol=0.01)
        assert np.isclose(a[:, 1], b[:, 1], rtol=0.05, atol=0.5).mean() > 0.95


def test_language_model_of_frequent_words_alone(spark):
    """Copies of one text: every n-gram is frequent, and no slice has a question for the filter."""
    copies = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b a c").alias("text"))
    got = lm_scoring.lm_scores(copies).collect()
    whole = lm_scoring.lm_scores(copies, max_filter=1 << 26).collect()
    assert len(got) == 50 and {r.n_tokens for r in got} == {r.n_known for r in got} == {5}
    assert len({r.score for r in got}) == 1 and np.isclose(got[0].score, whole[0].score)


def test_language_model_beats_words_alone(spark, small):
    rows_ = [r for r in lm_scoring.lm_scores(spark.read.parquet(f"{small}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows_) > sum(r.base_score for r in rows_)


def test_filter_counts():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 44, 20_000).astype(np.uint64))
    counts = rng.integers(1, 3000, len(keys))
    bits, block_bits = 4, 1 << 18
    data = np.concatenate([np.frombuffer(lm_scoring.Filter.block(keys[keys >> np.uint64(40) == b] & np.uint64((1 << 40) - 1), counts[keys >> np.uint64(40) == b], 3, block_bits), np.uint8) for b in range(16)])
    f = lm_scoring.Filter(block_bits, bits, 3, data)
    hashed = keys << np.uint64(20)
    assert (f.level(hashed) >= lm_scoring.levels(counts)).all() and (f.level(hashed) == lm_scoring.levels(counts)).mean() > 0.9
    assert (f.count(hashed + np.uint64(1 << 63)) > 0).mean() < 0.2


def test_packing(docs, empty):
    t = tokenizers.Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    want = []
    for i, text in TEXTS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    out = packing.pack(docs, str(P.path("byte_bpe_50k.json")))
    assert rows(out, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    full: dict[int, int] = {}
    for r in sorted(out.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= 1024 and len(full) <= -(-sum(w[3] for w in want) // 1024) + 2
    assert packing.pack(empty, str(P.path("byte_bpe_50k.json"))).count() == 0


def test_plan_fills_sequences():
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = Counter(rng.integers(1, 101, rng.integers(1, 400)).tolist())
        groups = packing.plan(dict(counts), 100)
        placed: Counter = Counter()
        for bins, inside in groups:
            assert sum(n * k for n, k in inside) <= 100 and bins > 0
            assert sum(k for n, k in inside if 3 * n > 100) <= 2
            for n, k in inside:
                placed[n] += bins * k
        assert placed == counts
        used, bound = sum(b for b, _ in groups), max(math.ceil(sum(n * c for n, c in counts.items()) / 100), sum(c for n, c in counts.items() if n > 50))
        assert used <= 1.15 * bound + 1


def test_media_columns(docs, empty):
    stored = media_columns.store_as_audio(docs)
    got = rows(media_columns.probe_audio(stored), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "crc_bad", "resync_bytes")
    want = []
    for i, t in TEXTS:
        p = raw(t)
        padded = p + bytes(-len(p) % 64 if p else 64)
        want.append((i, len(p), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), 0, 0))
    assert got == sorted(want, key=repr) and media_columns.store_as_audio(empty).count() == 0


def test_audio_parser_resynchronises_and_sees_damage():
    payload = bytes(range(32, 127)) * 40
    good = media_columns.write_audio(payload)
    p = media_columns.parse_audio(good)
    assert p["vbr"]["frames"] == len(p["offsets"]) and p["bad"] == 0 and p["samples"] == 1152 * len(p["offsets"])
    assert media_columns.read_payload(good, p) == payload
    at = p["offsets"][1]
    q = media_columns.parse_audio(good[:at] + b"\xffgarbage\xff\xfb" + good[at:] + b"TAG" + b"title".ljust(125, b"\0"))
    assert q["lost"] == 10 and len(q["offsets"]) >= len(p["offsets"]) - 1 and q["fields"]["TIT2"] == "title"
    broken = bytearray(good)
    broken[at + 10] ^= 1
    assert media_columns.parse_audio(bytes(broken))["bad"] == 1
    # Frames of two rates: the duration is the sum of each rate's. A Layer II frame's checksum isn't verified but counted.
    frames = [bytes((0xFF, b, 0x90 | rate << 2, 0)).ljust(size, b"\0") for b, rate, size in ((0xFB, 0, 417), (0xFB, 1, 384))]
    assert media_columns.parse_audio(frames[0] * 100 + frames[1] * 100)["us"] == 115_200 * 1_000_000 // 44_100 + 2_400_000
    assert media_columns.parse_audio(bytes((0xFF, 0xFC, 0x90, 0)).ljust(522, b"\0") * 3)["unchecked"] == 3
    # A VBRI table of more than 4096 entries is read whole.
    table = b"VBRI" + bytes(6) + (9).to_bytes(4, "big") + (8).to_bytes(4, "big") + b"\x13\x88" + b"\0\1" + b"\0\2" + bytes(2) + b"\0\7" * 5000
    assert media_columns.parse_vbr(frames[0][:36] + table, 0, media_columns.header(frames[0][:4]))["toc"] == [7] * 5000
    for junk in (b"", b"ID3", b"\xff" * 50, bytes(1000)):
        assert media_columns.parse_audio(junk)["offsets"] == []


def test_token_counts(docs, empty):
    import sentencepiece

    path = str(P.path("piece_bpe_32k.model"))
    s = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i, len(raw(t)), len(s.encode(t or "")), len(s.encode(t or "")) > 4096) for i, t in TEXTS), key=repr)
    for most in (1 << 19, 5):
        assert rows(token_counts.token_counts(docs, path, max_broadcast=most), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_license_scan(docs, empty):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def lower(b):
        return b.translate(bytes(x + 32 if 65 <= x <= 90 else x for x in range(256)))

    sets = [(label, set(word.findall(lower(t.encode())))) for label, t in license_scan.TEMPLATES]
    want = []
    for i, t in TEXTS:
        w = word.findall(lower(raw(t)))
        places, base = [], set()
        for phrase, label in license_scan.PHRASES.items():
            q = phrase.encode().split()
            for k in range(len(w) - len(q) + 1):
                if w[k : k + len(q)] == q:
                    places.append(k)
                    base.add(label)
        best, labels = float(bool(places)), set(base)
        for block in raw(t).split(b"\n"):
            own = set(word.findall(lower(block)))
            for label, s in sets:
                if len(own & s) / len(s) >= 0.9:
                    labels.add(label)
                    best = max(best, len(own & s) / len(s))
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best))
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert rows(license_scan.license_scan(docs), *cols) == sorted(want, key=repr)
    assert any("cc-by-nc-4.0" in r[6] for r in want) and license_scan.license_scan(empty).count() == 0


def test_license_scan_of_wrapped_notices(spark):
    import textwrap

    texts, want = [], {}
    for k, (label, template) in enumerate(license_scan.TEMPLATES):
        wrapped = ["# " + x for x in textwrap.wrap(template, max(12, len(template) // 3))]
        texts.append((k, "\n".join(["first line", *wrapped, "last line"])))
        # The same words, each among many others, are no notice.
        texts.append((100 + k, "\n".join(" ".join([w, *(f"x{j}" for j in range(60))]) for w in template.replace(",", "").split())))
        want[k] = (label, list(range(1, len(wrapped) + 1)))
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    for k, (label, lines) in want.items():
        assert len(lines) > 1 and label in got[k].labels.split(",") and got[k].score == 1.0 and set(got[k].blocks) <= set(lines) and got[k].blocks
        assert label not in got[100 + k].labels.split(",") and not got[100 + k].blocks


def test_line_dedup(docs, empty):
    holders: dict[str, set] = {}

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    for i, t in TEXTS:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    want = []
    for i, t in TEXTS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 3 or i == max(holders[key(x)])]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    for batches in (1, 7):
        got = line_dedup.line_dedup(docs, batches=batches).withColumn("text", F.coalesce("text", F.lit("")))
        assert rows(got, "doc_id", "n_lines", "n_dropped", "text") == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 2 and line_dedup.line_dedup(empty).count() == 0


def test_decontamination(spark, docs, empty):
    passage = dict(TEXTS)[5].split()
    swapped = [*passage[:10], "swap", *passage[11:20], "swap", *passage[21:30]]
    items = spark.createDataFrame([(1, " ".join(passage[5:45])), (2, " ".join(swapped)), (3, "too short"), (4, None), (5, " ".join(f"q{k}" for k in range(30)))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(i, k) for i in (None, 5, 6, 17) for k in (1, 2)}
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items, max_broadcast_words=0).collect()} == got
    assert decontamination.contaminated(empty, items).count() == 0 == decontamination.contaminated(docs, items.where("item_id = 3")).count()
    # A short item is found where all of its words stand in a row.
    short = spark.createDataFrame([(1, "Two, three FOUR"), (2, "four two"), (3, " ?! ")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id, r.n_hits, r.first_word) for r in decontamination.contaminated(docs, short).collect()] == [(21, 1, 1, 1)]


def test_decontamination_of_long_texts_by_shuffle(spark):
    """Rows of the shuffle join hold no texts, so that one long text costs no more than its words; both ways give the same."""
    rng = np.random.default_rng(5)
    item = [f"i{k}" for k in range(40)]
    text = [f"t{k}" for k in rng.integers(0, 900, 20_000)]
    text[9000:9030] = item[5:35]
    text[9010] = "changed"
    texts = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(item[:30])), (None, " ".join(item))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(f"t{k}" for k in range(50)))], "item_id bigint, text string")
    both = [rows(decontamination.contaminated(texts, items, max_broadcast_words=most), "doc_id", "item_id", "n_hits", "first_word", "similarity") for most in (500_000, 0)]
    assert both[0] == both[1] and {r[:2] for r in both[0]} == {(1, 1), (2, 1), (None, 1)}


def test_decontamination_counts_repeated_rows_alike_both_ways(spark):
    item = [f"i{k}" for k in range(30)]
    passage = [x if k % 7 else f"s{k}" for k, x in enumerate(item)]
    texts = spark.createDataFrame([(1, " ".join(passage))] * 3 + [(2, " ".join(item)), (None, " ".join(item[:20]))], "doc_id bigint, text string")
    for items in ([(1, " ".join(item))], [(1, " ".join(item))] * 2):
        table = spark.createDataFrame(items, "item_id bigint, text string")
        both = [rows(decontamination.contaminated(texts, table, max_broadcast_words=most), "doc_id", "item_id", "n_hits", "first_word", "similarity") for most in (500_000, 0)]
        assert both[0] == both[1] and len(both[0]) == 3


def test_items_of_one_text_are_searched_once(spark, monkeypatch):
    """What goes to all workers has a row for each place and mask of a different text, without the text; items with a text of others have its hits, and repeated rows count again."""
    item = [f"i{k}" for k in range(30)]
    long, other, short = " ".join(item), " ".join(item[:12]), "Two three"
    texts = spark.createDataFrame([(1, " ".join([*item[:20], "x", *item[21:]])), (2, "one two three"), (None, long)], "doc_id bigint, text string")
    table = [(k, long) for k in range(40)] + [(40, long), (40, long), (40, other), (41, other), (42, short), (43, short), (None, long), (44, None)]
    for most in (500_000, 0):
        found = decontamination.contaminated(texts, spark.createDataFrame(table, "item_id bigint, text string"), max_broadcast_words=most)
        alone = {t: {r[0]: r[1:] for r in decontamination.contaminated(texts, spark.createDataFrame([(1, t)], "item_id bigint, text string"), max_broadcast_words=most).select("doc_id", "n_hits", "first_word", "similarity").collect()} for t in (long, other, short)}
        want = {}
        for i, t in table:
            for d, (n, first, like) in alone.get(t, {}).items():
                a = want.get((d, i), (0, first, like))
                want[d, i] = (a[0] + n, min(a[1], first), max(a[2], like))
        assert {(r["doc_id"], r["item_id"]): (r["n_hits"], r["first_word"], r["similarity"]) for r in found.collect()} == want and len(want) == 88
    sent = []
    monkeypatch.setattr(decontamination.F, "broadcast", lambda df, mark=F.broadcast: sent.append(df) or mark(df))
    decontamination.contaminated(texts, spark.createDataFrame(table * 50, "item_id bigint, text string"))
    places = [df for df in sent if "seed" in df.columns and "j" in df.columns]
    assert len(places) == 1 and places[0].dtypes == [("ref", "bigint"), ("j", "int"), ("seed", "bigint")]
    assert places[0].count() == sum(n - m for n in (30, 12) for m in (4, 5, 7))


def test_decontamination_by_any_window(spark):
    """Brute force over all aligned windows of 16, with passages of 16 words and three or fewer substitutions inside longer items and documents."""
    rng = np.random.default_rng(11)
    items, texts = [], []
    for k in range(60):
        item = [f"i{k}w{i}" for i in range(48)]
        passage = list(item[16:32])
        for j in rng.choice(16, k % 4, replace=False):
            passage[j] = f"s{k}x{j}"
        items.append((k, " ".join(item)))
        texts.append((k, " ".join([*(f"a{k}b{i}" for i in range(20)), *passage, *(f"c{k}d{i}" for i in range(20))])))
    want = set()
    for (k, item), (_, text) in zip(items, texts, strict=True):
        x, y = item.split(), text.split()
        if any(sum(map(str.__eq__, x[a : a + 16], y[b : b + 16])) >= 0.8 * 16 for a in range(33) for b in range(len(y) - 15)):
            want.add((k, k))
    got = decontamination.contaminated(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert len(want) == 60 and {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.first_word <= 20 + 3 and r.first_word >= 20 - 3 and r.similarity >= 0.8 for r in got)


def near_groups(df):
    table = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if r.doc_id is not None]
    sets = {}
    for i, t in table:
        w = raw(t).lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    holders: dict[bytes, list] = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in holders[x] if j > i).items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return {i: find(i) for i in group}


# The second setting leaves all pairs to the exact join, the third with the shortest prefixes.
HUBS = ({}, {"rounds": 0}, {"rounds": 1, "least": 1})


def test_near_copies(spark, small, docs, empty):
    for df, settings in ((spark.read.parquet(f"{small}/documents.parquet"), HUBS[:1]), (docs, HUBS)):
        want = near_groups(df)
        for how in settings:
            assert {r.doc_id: r.component for r in near_copies.near_copies(df, **how).collect()} == want
    left = near_copies.without_near_copies(docs)
    assert left.columns == docs.columns and left.where("doc_id is null").count() == 1
    assert near_copies.near_copies(empty).count() == 0


def test_near_copies_keep_one_of_each_group(spark):
    """Different texts under one doc_id are told apart, and of repeated rows one stays."""
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (1, "something else altogether"), (1, " ".join(words)), (2, " ".join(words[:59])), (3, "something else altogether"), (4, None), (5, ""), (None, "x"), (None, "x")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, size string")
    kept = near_copies.without_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, " ".join(words)), (1, "something else altogether"), (4, None), (None, "x"), (None, "x")], key=repr)


def test_long_runs_have_hashes_of_their_own():
    """Two complementary sequences that a polynomial modulo a power of two gives one value, whatever its base."""
    from tidegauge.llm.batches import run_hashes

    for n in (1024, 4096):
        bits = np.array([k.bit_count() & 1 for k in range(n)], np.uint64)
        both = np.concatenate([bits, 1 - bits])
        a, b = run_hashes(both, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b and a == run_hashes(bits, np.array([0]), np.array([n]))[0]


def test_near_copies_with_new_words(spark):
    """Words new to the corpus weigh most, so that copies with some differ in every segment of the fingerprint."""
    rng = np.random.default_rng(3)
    texts = []
    for k in range(60):
        base = [f"w{i}" for i in rng.integers(0, 300, 40 + 8 * k)]
        texts.append(base)
        for c in range(2):
            new = list(base)
            for j in rng.choice(len(base), max(1, len(base) // 60), replace=False):
                new[j] = f"new{k}x{c}x{j}"
            texts.append(new)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = near_groups(df)
    assert sum(i != g for i, g in want.items()) > 40
    for how in ({}, {"max_bits": 0}):
        assert {r.doc_id: r.component for r in near_copies.near_copies(df, **how).collect()} == want


def test_components_of_a_long_path(spark):
    from tidegauge.llm.components import components

    n = 200
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(500, 501), (501, 501), (501, 500)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {500: 500, 501: 500}
    assert components(edges.where("a < 0")).count() == 0
