"""Training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeats, extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import bpe_sql, chat, exact_dedup, langid, ngram_join, packing, pii, quality, substring_dedup, token_files, tokens
from pixelmill.llm.common import JSON_VOCAB

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, digest string, kept boolean, k long"


def prose(r, n):
    return " ".join("".join(r.choice(["ba", "né", "ti", "or", "th", "ß", "x1", "o'"]) for _ in range(r.randint(1, 4))) + r.choice(["", "", ".", ",", ".\n"]) for _ in range(n))


def rows(seed=1):
    r = random.Random(seed)
    base = prose(r, 300)
    words = base.split(" ")
    near = " ".join(words[:150] + ["changed"] + words[151:])
    passage = prose(r, 80)
    texts = [base, base, near, base.upper(), prose(r, 200) + "\n" + passage + "\n" + prose(r, 90), prose(r, 100) + "\n" + passage + "\n" + prose(r, 120), None, "", " \n\t ", "a b c", "A  B c", "one", "x" * 5000, "  lead  and   odd ½ ² \x1f signs \r\n", prose(r, 6000), "same line\n" * 70, "<|endoftext|> 日本語 \U0001f600 don't"]
    out = [(i, t, "clash", True, 7) for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, base, "clash", None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def library(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON_VOCAB)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    enc = tokens.Encoder(JSON_VOCAB, max_words=50)
    texts = [t or "" for _, t, *_ in rows()] + ["a  b", " a", "a ", "\n\n a\n\nb", "'s 't x's", "a\n b \nc", "1_2 __ 3"]
    for _ in range(2):  # again with whatever is remembered
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [library(t) for t in texts]


def test_exact_dedup(docs, none):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows():
        groups[t or ""].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    weak = lambda t: F.unhex(F.concat(F.substring(F.sha2(t, 256), 1, 1), F.lit("0" * 63)))
    for how in ({}, {"digest": weak, "memtable": 2}):
        got = exact_dedup.decisions(docs, **how).collect()
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact_dedup.survivors(docs)
    assert left.columns == docs.columns and sorted((r.text or "") for r in left.collect()) == sorted(groups)
    assert exact_dedup.decisions(none).count() == 0 and exact_dedup.survivors(none).count() == 0


def test_merge_index_levels():
    r = np.random.default_rng(1)
    keys = np.array([hashlib.sha256(bytes([x])).digest() for x in r.integers(0, 200, 3000)], "S32")
    ids = r.integers(0, 10**6, 3000)
    index = exact_dedup.MergeIndex(64)
    index.add(keys, ids, np.ones(3000, np.int64))
    assert sum(map(len, index.levels)) > 1
    best, n = index.lookup(np.concatenate([keys, np.array([b"\1" * 32], "S32")]))
    for k, b, c in zip(keys, best, n, strict=False):
        assert b == ids[keys == k].max() and c == (keys == k).sum()
    assert n[-1] == 0


def test_quality(docs, none):
    want = collections.Counter()
    for i, t, *_ in rows():
        t = t or ""
        w = WORD.findall(t)
        seen, cover = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)), set()
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    got = quality.decisions(docs).collect()
    assert collections.Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    kept = quality.kept(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.decisions(none).count() == 0
    plan = quality.kept(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    one = quality.cascade(docs, to="why")
    assert one.columns == [*docs.columns, "why"] and one.filter("why is null").count() == kept.count()


def test_quality_stops_at_the_first_rule_that_rejects(spark):
    """A rule is not evaluated on a text that an earlier one rejects: here it would fail."""
    df = spark.createDataFrame([(1, "bad text"), (2, "good text"), (3, None)], "doc_id long, text string")
    calls = {
        "cheap": quality.Rule(lambda t, w: ~t.contains("good"), None),
        "dear": quality.Rule(lambda t, w: F.when(t.contains("good"), F.lit(False)).otherwise(F.raise_error(F.lit("evaluated")).cast("boolean")), None),
    }
    why = quality.verdict(F.coalesce("text", F.lit("")), ["cheap", "dear"], calls)
    assert [r.why for r in df.withColumn("why", why).orderBy("doc_id").collect()] == ["cheap", None, "cheap"]
    with pytest.raises(Exception, match="evaluated"):
        df.withColumn("why", quality.verdict(F.coalesce("text", F.lit("")), ["dear", "cheap"], calls)).collect()
    order = quality.order_rules(spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("words of text "), 300).alias("text")), rules={"never": quality.RULES["no_letter"], "always": quality.Rule(lambda t, w: t.contains("text"), None)})
    assert [x["rule"] for x in order] == ["always", "never"] and [x["rejects"] for x in order] == [1.0, 0.0]


def components(texts, percent=80):
    sets = {}
    for i, t in texts:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join(spark, docs, none):
    want = components([(i, t) for i, t, *_ in rows() if i is not None])
    got = ngram_join.clusters(docs).collect()
    assert len(got) == len(rows()) and {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.clusters(none).count() == 0


def test_ngram_join_chains(spark):
    """A long chain of near copies is one component; texts that share a passage only are not linked."""
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(60):
        texts.append((1000 - i, " ".join(words)))
        words = list(words)
        words[r.randrange(len(words))] = f"new{i}"
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [(2000 + i, " ".join(f"q{r.randrange(10**6)}" for _ in range(90)) + " " + passage) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.clusters(df, hot=5, few=2, share=16).collect()}
    assert got == components(texts)
    left = {x.doc_id for x in ngram_join.representatives(df).collect()}
    assert left == {c for _, c in components(texts).values()}


def test_ngram_join_common_passage(spark):
    """A shingle that all documents hold, in many components: near copies of several texts, and texts alone, around one passage."""
    r = random.Random(11)
    passage = [f"p{k}" for k in range(40)]
    texts = []
    for g in range(30):
        own = [f"w{r.randrange(10**6)}" for _ in range(r.randint(20, 60))]
        for k in range(r.choice([1, 1, 2, 6])):
            words = passage + own
            for _ in range(r.choice([0, 1, 3])):
                words = list(words)
                words[r.randrange(40, len(words))] = f"new{r.randrange(10**6)}"
            texts.append((r.randrange(10**9), " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = components(texts)
    assert 10 < len({c for _, c in want.values()}) < len(texts)
    for how in ({}, {"hot": 5, "share": 4}, {"few": 0, "share": 4}, {"few": 10**6}):
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.clusters(df, **how).collect()} == want


def test_ngram_join_two_texts_of_one_id(spark):
    """An id with two texts, the smallest of both classes, has the links of both."""
    r = random.Random(8)
    texts = []
    for i in range(0, 40, 4):
        for k in (1, 2):
            words = [f"w{r.randrange(10**6)}" for _ in range(100)]
            texts += [(i, " ".join(words)), (i + k, " ".join([*words[:50], "changed", *words[51:]]))]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {(x.doc_id, x.component_id) for x in ngram_join.clusters(df).collect()}
    assert got == {(i, i - i % 4) for i, _ in texts}


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms(spark, none):
    cards = ["4111 1111 1111 1111", "5500005555555559", "9807915762804490"]
    texts = [f"card {c}! again {c}" for c in cards] + ["born 1987-02-28 or 02/28/1987, 28.02.1987", "1999-02-30", "mail für.34@mail7.example.com, ip 97.51.17.173 +1 (974) 555-3436", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "DE89 3704 0044 0532 0130 00", None, "", "v1.2 and 12 % of 3, nothing else"]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, n_private string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df.select("doc_id", "text"), "key", count_col="n_private").collect()}
    for i, c in enumerate(cards):
        a, b = re.findall(r"\d[\d ]+\d", got[i])
        assert a == b != c and re.sub(r"\d", "9", a) == re.sub(r"\d", "9", c)
        assert luhn(a.replace(" ", "")) == luhn(c.replace(" ", ""))
    d = re.fullmatch(r"born (\d{4})-(\d\d)-(\d\d) or (\d\d)/(\d\d)/(\d{4}), (\d\d)\.(\d\d)\.(\d{4})", got[3]).groups()
    assert d[:3] == (d[5], d[3], d[4]) == (d[8], d[7], d[6]) != ("1987", "02", "28")  # one day in three formats stays one day
    assert got[4] != texts[4] and "example.com" not in got[5] and "97.51.17.173" not in got[5] and "555-3436" not in got[5] and "04dbebab" not in got[6]
    iban = got[7].replace(" ", "")
    assert iban != "DE89370400440532013000" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[8] is None and got[9] == "" and got[10] == texts[10]
    assert pii.pseudonymise(none, "key").columns == none.columns and pii.pseudonymise(none, "key").count() == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("d"), F.col("id"))
    two = {r[0] for r in df.select(pii.permute_digits(F.col("d"), "k", "t")).collect()}
    days = {r[0] for r in df.select(pii.feistel(F.col("id"), F.lit(4).cast("long"), F.lit(25).cast("long"), "k", "t")).collect()}
    assert len(two) == 100 and all(len(x) == 2 for x in two) and days == set(range(100))


def test_packing(docs, none):
    got = packing.pack(docs, capacity=64, group_docs=5).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for s in by.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))] and sum(r.length for r in s) <= 64
        fill = sum(r.length for r in s)
        assert {r.padded_length for r in s} == {fill if fill & (fill - 1) == 0 else 64}
    want = collections.Counter()
    for i, t, *_ in rows():
        ids = [*library(t), 0]
        for k in range(0, len(ids), 64):
            want[i, k, len(ids), np.array(ids[k : k + 64], "<u4").tobytes()] += 1
    assert collections.Counter((r.doc_id, r.start, r.doc_tokens, bytes(r.ids)) for r in got) == want
    assert packing.pack(none).count() == 0


def test_packing_draws_by_document(spark):
    """The groups do not depend on the order or the partitions of the rows; repeated rows and long documents are spread."""
    r = random.Random(9)
    df = spark.createDataFrame([(i, prose(r, 5)) for i in range(200)], "doc_id long, text string")
    place = lambda x: {p.doc_id: p.grp for p in packing.pieces(x, 20).collect()}
    first = place(df.repartition(5))
    assert first == place(df.orderBy(F.desc("doc_id")).coalesce(1)) and len(set(first.values())) > 15
    same = collections.Counter(p.grp for p in packing.pieces(spark.createDataFrame([(1, "one text")] * 400, "doc_id long, text string").coalesce(1), 20).collect())
    long = collections.Counter(p.grp for p in packing.pieces(spark.createDataFrame([(1, prose(r, 9000))], "doc_id long, text string"), 20, capacity=8).collect())
    assert max(same.values()) < 60 and len(long) > 10


def test_first_fit_decreasing():
    r = random.Random(2)
    sizes = [r.randint(1, 100) for _ in range(500)]
    bins, offsets, fill = packing.first_fit_decreasing(sizes, 100)
    room = []
    for i in sorted(range(500), key=lambda i: (-sizes[i], i)):
        k = next((k for k, x in enumerate(room) if x >= sizes[i]), len(room))
        room += [100] * (k == len(room))
        assert bins[i] == k and offsets[i] == 100 - room[k]
        room[k] -= sizes[i]
    assert fill == [100 - x for x in room]


def test_token_files(docs, none, tmp_path):
    files = token_files.write(docs, str(tmp_path / "t"))
    got = token_files.read(docs.sparkSession, str(tmp_path / "t"), files).collect()
    at, want = 0, collections.Counter()
    assert [r.start for r in sorted(got, key=lambda r: r.start)] == np.cumsum([0, *[r.n_tokens for r in sorted(got, key=lambda r: r.start)]])[:-1].tolist()
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == collections.Counter((i, np.array([*library(t), 2], "<u4").tobytes()) for i, t, *_ in rows())
    assert {r.ids_crc32 for r in token_files.digests(token_files.round_trip(docs)).collect()} == {zlib.crc32(bytes(r.ids)) for r in got}
    assert token_files.round_trip(none).count() == 0


def test_blocks():
    r = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 3000):
        for hi in (1, 2, 50000, 2**32 - 1):
            x = r.integers(0, hi, n, dtype=np.uint64).astype(np.uint32)
            x[::97] = 2**32 - 1
            blocks = token_files.pack_blocks(x)
            starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
            assert (token_files.unpack_blocks(np.frombuffer(b"".join(blocks), np.uint8), starts, n) == x).all()


def test_bpe_sql(spark, docs, none):
    got = bpe_sql.encode(docs).collect()
    want = collections.Counter((i, " ".join(map(str, library(t))), (t or "").encode()) for i, t, *_ in rows())
    assert collections.Counter((r.doc_id, r.ids, bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids.split()) for r in got) and bpe_sql.encode(none).count() == 0
    lists = spark.createDataFrame([(1, library("héllo wörld")), (2, []), (3, None)], "i long, ids array<long>")
    assert {r.id: bytes(r.decoded) for r in bpe_sql.decode(lists, "i", "ids").collect()} == {1: "héllo wörld".encode(), 2: b"", 3: b""}


def test_bpe_sql_long_words(spark):
    """Pre-tokens of any length, against the ranks' own library; a hundred thousand bytes end soon."""
    import base64
    import time

    import tiktoken
    from public_tokenizers import PATTERN

    with open(bpe_sql.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (255, 256, 257, 600, 5000, 100_000)]
    texts += ["a" * 5000, "ab" * 3000, "=-" * 2000, "é" * 1000, "x" * 257, "the" * 700, "0123456789" * 500, " " * 3000, "aaaaaaab" * 300, "日本" * 400, "".join(r.choices("ab", k=3000))]
    began = time.time()
    got = {x.doc_id: x for x in bpe_sql.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()}
    assert time.time() - began < 60
    for i, t in enumerate(texts):
        assert got[i].ids == " ".join(map(str, plain.encode_ordinary(t))) and bytes(got[i].decoded) == t.encode()


def test_substring_dedup(docs, none):
    found = collections.defaultdict(set)
    key = lambda i, t: (-(1 << 63) if i is None else i, t)
    for i, t, *_ in rows():
        if t is not None:
            for h, p in zip(*map(np.ndarray.tolist, substring_dedup.spans(t)), strict=True):
                found[h].add((key(i, t)[0], t, p))
    first = {h: min(x, key=lambda y: (y[0], y[2])) for h, x in found.items() if len({y[0] for y in x}) == len({y[:2] for y in x})}
    got = collections.Counter(tuple(r)[:2] for r in substring_dedup.dedup(docs).collect())
    want = collections.Counter()
    for i, t, *_ in rows():
        cover = set()
        if t is not None:
            for h, p in zip(*map(np.ndarray.tolist, substring_dedup.spans(t)), strict=True):
                if first[h] != (key(i, t)[0], t, p):
                    cover |= set(range(p, p + substring_dedup.RUN))
        want[i, None if t is None else substring_dedup.without(t, cover)[0]] += 1
    assert got == want and substring_dedup.dedup(none).count() == 0


def left_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return [r.text for r in substring_dedup.dedup(df).orderBy("doc_id").collect()]


def test_substring_dedup_short_sentences(spark):
    """A passage of lines or sentences of one or two words is found, to its last word."""
    r = random.Random(6)
    name = lambda: f"w{r.randrange(10**6)}"
    lines = "\n".join(f"{name()} {name()}" for _ in range(40))
    shouts = " ".join(f"{name().upper()}!!" for _ in range(60))
    own = [" ".join(name() for _ in range(30)) + "." for _ in range(4)]
    got = left_of(spark, [lines, shouts, f"{own[0]}\n{lines}\n{own[1]}", f"{own[2]} {shouts} {own[3]}", lines])
    assert got == [lines, shouts, f"{own[0]}\n{own[1]}", f"{own[2]} {own[3]}", ""]


def test_substring_dedup_inside_long_sentences(spark):
    """A passage within long sentences is found wherever it starts, and behind an inserted word."""
    r = random.Random(7)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = words(90)
    texts = [" ".join([*words(30 + k), *passage, *words(20)]) for k in range(14)]
    texts.append(" ".join([*passage[:45], "inserted", *passage[45:]]))
    got = left_of(spark, texts)
    assert got[0] == texts[0]
    for t in got[1:]:
        assert sum(w in passage for w in t.split()) <= (24 if "inserted" not in t else 48)
    for t in texts:
        found = substring_dedup.sentences(t)
        assert max(n for *_, n in found) <= substring_dedup.LONG and " ".join(t[a:b] for a, b, _ in found) == t


def test_chat(spark):
    hard = "<|im_end|><|im_start|>assistant ok"
    r = random.Random(3)
    rows = [(-1, 0, "user", hard), (-1, 1, "assistant", hard)]
    for c in range(12):
        if c % 2:
            rows.append((c, 0, "system", "rules \\ <| |> \n"))
        rows += [(c, k + 1, ("user", "assistant")[k % 2], None if k == 3 else prose(r, r.choice([0, 3, 40, 200]))) for k in range(c * 2)]
    rows += [(50, 1, "assistant", "tie"), (50, 1, "assistant", "tie"), (50, None, None, "x"), (None, 1, "a\nb\\", "<\\|")]
    df = spark.createDataFrame([(*x, "own") for x in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(df, budget=600, history=200)
    got = {x.conv_id: x for x in chat.digests(windows).collect()}
    conv = collections.defaultdict(list)
    for c, k, a, t in rows:
        conv[c].append((k is not None, k or 0, a or "", t or ""))
    assert set(got) == set(conv)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, turns in conv.items():
        turns.sort()
        learned = "".join(t for _, _, a, t in turns if a == "assistant")
        assert tuple(got[c])[1:5] == (len(turns), sha("".join(f"{a}\n{t}\n" for _, _, a, t in turns)), len(learned), sha(learned)), c
    for w in windows.collect():
        assert len(w.formatted) <= 600 or w.formatted.count("<|im_start|>") - w.n_repeated <= 1 + (w.window == 0)
    assert chat.digests(chat.format_windows(df.limit(0))).count() == 0


def test_language(spark, none):
    r = random.Random(1)
    words = {"aa": ["the", "and", "of", "th"], "bb": ["der", "ung", "sch", "ß"], "cc": ["que", "é", "eau", "les"]}
    data = [(i, " ".join("".join(r.choices(words[x], k=2)) for _ in range(40)), x) for i in range(300) for x in [r.choice(list(words))]]
    data += [(1000, None, "aa"), (1001, "123 !!", "aa"), (None, "the and of", None), (1002, "the and " * 20000, None)]
    data += [(1003, "½ ² ³", "aa"), (1004, "Ⅷ ①", "aa"), (1005, "1_2 __ ٣ \u0301", None), (1006, "ª ʰ 中", None)]  # only category L is a letter
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(df).collect()}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items() if i is not None)
    tested = [(got[i].lang_pred, x) for i, _, x in data[:300] if got[i].held_out]
    assert np.mean([a == b for a, b in tested]) > 0.95
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "aa" and all(0 <= x.score <= 1 for x in got.values())
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1003, 1004, 1005)) and got[1006].lang_pred != "und"
    empty = none.withColumn("lang", F.lit(None).cast("string"))
    assert langid.identify(empty).count() == 0


def test_language_one_text_or_many(spark):
    """A text's answer does not depend on the texts beside it: batched windows against one text at a time."""
    r = random.Random(3)
    texts = ["".join(r.choices("abcdeé ", k=r.choice([1, 5, 191, 192, 193, 900]))) + "a" for _ in range(60)]
    net = langid.Network(3)
    got = {x.doc_id: x for x in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), (["a", "b", "c"], net)).collect()}
    for i, t in enumerate(texts):
        data = t.encode()
        rows = [data[k : k + 192] for k in range(0, len(data), 192)]
        x = np.stack([np.frombuffer(y.ljust(192, b"\0"), np.uint8) for y in rows])
        p = np.average(net.probabilities(x, net.tables()), axis=0, weights=[len(y) for y in rows])
        assert got[i].lang_pred == "abc"[p.argmax()] and abs(got[i].score - p.max()) < 1e-5


def test_language_sample_is_bounded(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "if(id % 3 = 0, 'a', 'b') AS lang")
    got = langid.sample(df, "text", "lang", "doc_id", 50, 500, 400, 5)
    assert {r.lang: r["count"] for r in got.groupBy("lang").count().collect()} == {"a": 50, "b": 50}


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    net = langid.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = r.integers(1, 256, (8, 24)).astype(np.uint8), r.integers(0, 3, 8)

    def loss():
        p = net.probabilities(x, {k: v.astype(np.float64) for k, v in net.tables().items()})
        return -np.log(p[np.arange(8), y]).mean()

    g = net.gradients(x, y)
    for name in ("out", "W3", "bias"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.p[name][at] += 1e-2
        up = loss()
        net.p[name][at] -= 2e-2
        down = loss()
        net.p[name][at] += 1e-2
        assert abs((up - down) / 2e-2 - g[name][at]) < 0.05 * abs(g[name][at]) + 1e-3
