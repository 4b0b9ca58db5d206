import hashlib
import math
import random
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import of_duck, of_spark
from pyspark.sql import functions as F

from aerolith.llm import bpe, chat, common, components, decontam, lm, neardup, quality, registry, repeats, store, substring, suffix, toxicity

public = pytest.importorskip("public_tokenizers")
CLASH = "n long, rep long, z string, key long, spans string, lang string, source string"


def table(spark, rows):
    """rows: (doc_id, text); other columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, 1, 2, "z", 3, "s", "en", "src") for i, t in rows], f"doc_id long, text string, {CLASH}")


def words(rng, n, of=400):
    return " ".join(rng.choice(f"w{k}x w{k} Ab{k}c, é{k}. {k}".split()) for k in (rng.randrange(of) for _ in range(n)))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, repeated rows, nulls, empty and short texts, one long text."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 300)) for _ in range(30)]
    out = list(enumerate(base))
    for k in range(30, 60):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        out.append((k, " ".join(w)))
    passage = words(rng, 60)
    out += [(k, f"{words(rng, 40)}\n{passage}\n{words(rng, 20)}") for k in range(60, 70)]
    out += [(70, None), (71, ""), (72, " \n\t "), (73, "one two"), (74, "One  two"), (None, "no id has this text at all"), (75, words(rng, 30_000)), (76, "ab" * 400), (77, "été " * 120), (3, base[3])]
    return out


SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPLIT.split(text or "") if w]


def test_quality_against_brute_force(spark, rows):
    got = quality.judge(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        w, r = split(t), by[i]
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in got if r.kept}
    assert {r.doc_id for r in quality.passing(table(spark, rows)).collect()} == kept
    assert quality.judge(table(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_near_duplicates", "op5_substring_dedup", "op9_chat_format"])
def test_query_matches_sql(spark, duck, sf, name):
    assert of_spark(registry.queries()[name](spark, sf)) == of_duck(duck, registry.oracle_sql()[name])


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "&lt;| & &amp; <|im_sep|> <", "", None, "a\nb"]
    turns = [(c, t, r, said[(c + t) % 5]) for c in range(6) for t, r in enumerate(["system", "user", "user", "assistant", "assistant", "use\nr", None])] + [(None, None, "user", "x"), (7, 1, "user", "x"), (7, 1, "user", "x")]
    df = spark.createDataFrame([(*t, "f", 1) for t in turns], "conv_id long, turn long, role string, text string, formatted string, loss int")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    for c in {t[0] for t in turns}:
        mine = sorted(((t if t is not None else -1), r or "", x or "") for cc, t, r, x in turns if cc == c)
        assert [(t.role, t.text) for t in got[c].turns] == [m[1:] for m in mine]
        assert list(got[c].learnt) == [m[2] for m in mine if m[1] == "assistant"]
    assert chat.formatted(df.limit(0)).count() == 0


def test_bpe_against_the_library(spark, rows):
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.load_ranks(f)
    whole = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*rows, (300, "  two  spaces\n next \t x \u3000 y \x1c z "), (301, " a"), (302, "a "), (303, "a  "), (304, "\n"), (305, "x" * 5000 + " y" * 300)]
    for at_spaces in (False, True):
        got = bpe.encode(table(spark, rows), path, public.PATTERN, at_spaces)
        by = {r.doc_id: np.frombuffer(r.ids, np.uint32).tolist() for r in got.collect()}
        assert all(by[i] == whole.encode_ordinary(t or "") for i, t in rows)
    assert {(r.doc_id, r.text) for r in bpe.decode(got, path).collect()} == {(i, t or "") for i, t in rows}
    rng = random.Random(2)
    texts = ["".join(rng.choice("aab  theéñ\n\t'sre1.ü😀") for _ in range(rng.randrange(60))) for _ in range(2000)]
    encoder = bpe.Encoder(ranks, public.PATTERN, True)
    ids, ends = encoder.encode(pa.array(texts))
    for t, a, b in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert ids[a:b].tolist() == whole.encode_ordinary(t) and encoder.decode(ids[a:b]) == t.encode()


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}
    ids = sorted(sets, key=lambda i: (i is not None, i or 0))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                lo, hi = sorted((ra, rb), key=lambda i: (i is not None, i or 0))
                top[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_against_brute_force(spark, rows):
    got = neardup.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    one = neardup.one_of_each(table(spark, rows))
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted({str(r.doc_id) for r in got if r.kept}) and one.columns == table(spark, rows).columns


def test_one_of_each_keeps_texts_that_share_an_id(spark):
    """Only equal or linked rows go, whatever ids say."""
    rng = random.Random(21)
    a, b, c, d, e = (words(rng, 80, 100_000) for _ in range(5))
    docs = [(None, a), (None, b), (None, b), (4, c), (4, d), (4, d), (5, f"{c} more"), (6, e), (7, f"{b} more")]
    got = neardup.one_of_each(table(spark, docs))
    assert got.columns == table(spark, docs).columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(0, a), (0, b), (4, c), (4, d), (6, e)])


def test_near_copies_of_one_original_meet_there(spark):
    """Copies differ from each other by more than the limit, but not from the original."""
    rng = random.Random(8)
    w = [f"t{k}" for k in range(300)]
    out = []
    for k in range(40):
        v = list(w)
        for at in rng.sample(range(300), 7):
            v[at] = f"e{k}_{at}"
        out.append((k, " ".join(v)))
    out.append((1000, " ".join(w)))
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, out)).collect()} == {i: c for i, (_, c) in brute_near(out).items()}


def test_near_duplicates_below_the_limit(spark):
    """Groups whose copies lie on both sides of the limit from their original; texts cut at several lengths; variants that share edits."""
    rng = random.Random(31)
    out = []
    for g in range(3):
        w = [f"g{g}t{k}" for k in range(150)]
        for k in range(40):
            v = list(w)
            for at in rng.sample(range(150), rng.randint(2, 9)):
                v[at] = f"e{rng.randrange(3)}" if g == 1 else f"e{g}_{k}_{at}"
            out.append((1000 * g + k + 1, " ".join(v)))
        out.append((1000 * g + 500, " ".join(w)))
    long = [f"c{k}" for k in range(400)]
    out += [(5000 + n, " ".join(long[:n])) for n in range(60, 400, 11)]
    out += [(6000 + n, " ".join(long[n:])) for n in range(0, 340, 17)]
    want = {i: c for i, (_, c) in brute_near(out).items()}
    for plan in (neardup.Plan(), neardup.Plan(rounds=0)):
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, out), plan).collect()} == want


def test_near_duplicates_of_texts_that_share_an_id(spark):
    rng = random.Random(33)
    a, b, c = (words(rng, 60, 100_000) for _ in range(3))
    docs = [(3, a), (3, b), (3, b), (1, f"{b} more"), (None, c), (None, f"{c} x"), (9, f"{a} y")]
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(table(spark, docs)).collect()), key=str)
    assert got == sorted([(3, 3, True), (3, 1, False), (3, 1, False), (1, 1, True), (0, 0, True), (0, 0, True), (9, 3, False)], key=str)


def test_no_texts_at_all(spark):
    empty = table(spark, [])
    assert neardup.near_duplicates(empty).count() == suffix.digests(empty).count() == substring.digests(empty).count() == 0


def brute_bytes(rows, length=100, kept=False):
    """By doc_id: counts and digest, or the bytes that are left."""
    seen, out = set(), {}
    for i, t in sorted(dict(rows).items(), key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            g = b[s : s + length]
            if g in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(g)
        left = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out[i] = left if kept else (len(b), len(b) - len(left), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("group", [2000, 1])
def test_suffix_dedup_against_brute_force(spark, rows, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    got = suffix.digests(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(rows)


def test_very_long_text_in_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1000)
    u = np.random.default_rng(1).integers(1, 1 << 60, 5000).astype(np.uint64)
    cut = repeats.Cut(100, 24, False)
    text, start, starts, place, _, _ = repeats.triggers(u, np.array([3000, 2000]), cut)
    covered = sorted((t, s + k) for t, s, n in zip(text, start, starts, strict=True) for k in range(n))
    assert covered == [(0, k) for k in range(2901)] + [(1, 3000 + k) for k in range(1901)] and (place >= 0).all()


def brute_words(rows, length=35):
    docs = {i: split(t) for i, t in rows}
    grams = Counter(tuple(w[k : k + length]) for w in docs.values() for k in range(len(w) - length + 1))
    out = {}
    for i, w in docs.items():
        gone = {j for k in range(len(w) - length + 1) if grams[tuple(w[k : k + length])] > 1 for j in range(k, k + length)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("group", [2000, 1])
def test_substring_dedup_against_brute_force(spark, rows, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    got = substring.digests(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(rows)


@pytest.mark.parametrize("group", [2000, 1])
def test_frequent_triggers_in_pieces(spark, rows, group, monkeypatch):
    """Every trigger with over a 30th of the phrases is dealt out, and what its pieces found is put together."""
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "SHARE", 30)
    many = [*rows, *((10_000 + k, f"{k % 7} " + "the same line again " * 12) for k in range(60))]
    docs, texts = many, table(spark, many)
    assert repeats.frequent(common.keyed(texts).withColumn("__text", F.lit(0).cast("long")), suffix._cut(100)).count() > 1
    got = suffix.digests(texts).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(docs)
    got = substring.digests(texts).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(docs)


def test_dedup_shuffles_phrases_and_texts_once(spark, monkeypatch):
    """With no side small enough to be sent whole, shuffles carry phrases once, by trigger, and texts once for both of their joins."""
    rng = random.Random(41)
    parts = [words(rng, 60, 3000) for _ in range(150)]
    docs = table(spark, [(k, " ".join(rng.choice(parts) if rng.random() < 0.5 else words(rng, 40, 3000) for _ in range(8))) for k in range(600)]).repartition(4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = shuffled()
    suffix.digests(docs).collect()
    wrote = sum(n for k, n in shuffled().items() if k not in before)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    phrases = repeats.phrases(docs.withColumn("__text", F.lit(0).cast("long")), suffix._cut(100)).count()
    assert wrote < 2 * phrases


@pytest.mark.parametrize("later", [True, False])
def test_seeds_extended_both_ways(later):
    """Extension finds the windows that a comparison of all windows finds; few words, so contexts agree over all lengths."""
    rng, known = random.Random(5), repeats.WordHashes()
    seeds, cut = substring._cut(35), repeats.Cut(35, 8, True)
    trigger, place, starts, sequences = [], [], [], []
    for seed in range(6):
        anchor = [b"a%d" % seed] * 8
        arms = [([rng.choice([b"x", b"y"]) for _ in range(27)], [rng.choice([b"x", b"y"]) for _ in range(27)]) for _ in range(4)]
        for _ in range(rng.randint(1, 25)):
            before, after = list(rng.choice(arms)[0]), list(rng.choice(arms)[1])
            for side in (before, after):
                if rng.random() < 0.5:
                    side[rng.randrange(27)] = b"z"
            lead = rng.randint(0, 27)
            n = rng.randint(1, lead + 1)
            sequences.append((before[27 - lead :] + anchor + after)[: n + 34])
            trigger.append(seed), place.append(lead), starts.append(n)
    found = [c.settled(sequences, np.array(trigger), np.array(place), np.array(starts), later, known) for c in (seeds, cut)]
    assert (found[0] == found[1]).all() and found[0].any() and not found[0].all()


def test_dedup_of_long_strings(spark):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdef ") for _ in range(900))
    docs = [(1, "q" + shared), (2, "r" + shared), (3, shared[:399]), (4, shared[100:500])]
    got = {r.doc_id: r.n_removed for r in suffix.digests(table(spark, docs), 400).collect()}
    assert got == {1: 0, 2: 900, 3: 0, 4: 400}
    with pytest.raises(ValueError):
        suffix.digests(table(spark, docs), 1 << 17)


@pytest.mark.parametrize("group", [2000, 1])
def test_repeats_of_rows_that_share_an_id(spark, group, monkeypatch):
    """Texts that share an id, or have none, are documents of their own; equal rows are one."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(15)
    same, other, own = (words(rng, n, 100_000) for n in (60, 50, 45))
    more = [words(rng, 80, 100_000) for _ in range(5)]
    docs = [(None, f"{same} {more[0]}"), (None, f"{same} {more[1]}"), (7, f"{own} {own} {more[2]}"), (7, words(rng, 200, 100_000)), (8, f"{more[3]} {other}"), (9, f"x {other}"), (8, words(rng, 150, 100_000)), (8, f"{more[3]} {other}"), (None, more[4]), (None, more[4])]
    texts = {(i, t): k for k, (i, t) in enumerate(docs)}
    want = brute_words([(k, t) for (_, t), k in texts.items()])
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(table(spark, docs)).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *want[texts[i, t]])) for i, t in docs)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(table(spark, docs)).collect()]
    orders = []
    for flip in (1, -1):
        for turn in (1, -1):
            for last in (1, -1):
                by = {None: flip, 7: turn, 8: last}
                ordered = sorted(texts, key=lambda d: (d[0] is not None, d[0] or 0, texts[d] * by.get(d[0], 1)))  # noqa: B023
                place = {d: k for k, d in enumerate(ordered)}
                want = brute_bytes([(place[d], d[1]) for d in ordered])
                orders.append(sorted(str((i, *want[place[i, t]])) for i, t in docs))
    assert sorted(map(str, got)) in orders


def test_distance_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n))) for n in (12, 25))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            row = [i + 1] + [0] * len(b) if (last := row) else row
            for j, y in enumerate(b):
                row[j + 1] = min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1)
        best = decontam.distance(a, b, len(a))
        assert best is not None and best[0] == min(row)


def test_decontamination_finds_edited_copies(spark, rows):
    rng = np.random.default_rng(6)
    r = random.Random(6)
    items = [(k, words(r, r.randint(8, 50), 100_000)) for k in range(40)] + [(98, None), (99, "short"), (None, words(r, 20, 100_000))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    planted = {}
    docs = list(rows)
    for k in range(200):
        i, t = items[k % 40]
        edits = len(decontam.plain(t)) * (k % 11) // 100
        copy = decontam._edited(decontam.plain(t), edits, rng).decode("utf-8", "ignore")
        docs.append((1000 + k, f"{words(r, 30)} {copy} {words(r, 30)}"))
        planted[1000 + k] = i
    got = {(x.doc_id, x.item_id) for x in decontam.matches(table(spark, docs), bench).collect()}
    found = sum((d, i) in got for d, i in planted.items())
    assert found >= 0.95 * len(planted)
    assert not {d for d, _ in got} - set(planted)
    left = decontam.clean(table(spark, docs), bench)
    assert {x.doc_id for x in left.collect()} == {i for i, _ in docs} - {d for d, _ in got} and left.columns == table(spark, docs).columns
    assert decontam.matches(table(spark, docs), bench.limit(0)).count() == 0


def test_decontamination_loses_no_copy(spark):
    """Copies with as many edits as allowed, also in the middle of a word; short items as they are."""
    rng, r = np.random.default_rng(3), random.Random(3)
    items = [(k, words(r, n, 100_000).replace("é", "")) for k, n in enumerate([3, 4, 6, 9, 14, 20, 30] * 3)] + [(50, "wq7 short"), (51, " \n ")]
    docs, planted = [], set()
    for k, (i, t) in enumerate(items[:-1]):
        p = decontam.plain(t)
        most = len(p) // 10 if len(p) >= 16 else 0
        for j in range(6):
            copy = decontam._edited(p, most if j % 2 else 0, rng).decode("utf-8", "replace")
            before, after = [('{"question":"', '"}'), ("zz" * r.randint(20, 40), "zz"), (words(r, 20) + " ", " " + words(r, 20))][j // 2]
            if decontam.distance(p, decontam.plain(before + copy + after), most):
                planted.add((10 * k + j, i))
            docs.append((10 * k + j, before + copy + after))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(planted) > 0.9 * len(docs)
    assert {(x.doc_id, x.item_id) for x in decontam.matches(table(spark, docs), bench).collect()} == planted
    assert {x.doc_id for x in decontam.clean(table(spark, docs), bench).collect()} == {d for d, _ in docs} - {d for d, _ in planted}


def test_decontamination_of_long_items(spark):
    """Passages of some thousand bytes with as many edits as allowed."""
    rng, r = np.random.default_rng(7), random.Random(7)
    items = [(k, words(r, n, 100_000).replace("é", "")) for k, n in enumerate([150, 300, 600, 900])]
    docs = []
    for k, t in items:
        p = decontam.plain(t)
        docs += [(10 * k + j, f"{words(r, 20)} {decontam._edited(p, len(p) // 10, rng).decode()} {words(r, 20)}") for j in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.matches(table(spark, docs), bench).collect()} == {(d, d // 10) for d, _ in docs}


def lower(text):
    return [*split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), "\n"]


def brute_model(docs, trained, plan, held):
    """Tokens, known tokens, base and score of each of docs (id, text) by the model of those that trained(id) names; the weights too."""
    low = [(i, lower(t)) for i, t in docs]
    grams = lambda w: list(zip(["\n", *w], w, strict=False))
    one, two, one_held, two_held = Counter(), Counter(), Counter(), Counter()
    for k, (i, w) in enumerate(low):
        if trained(i):
            one.update(w)
            two.update(grams(w))
            if k in held:
                one_held.update(w)
                two_held.update(grams(w))
    n, size = sum(one.values()), len(one)
    kept = n - sum(one_held.values())
    events = Counter()
    for (a, b), c in two_held.items():
        cx = one[a] - one_held[a]
        events[int(math.log2(max(cx, 1))), (two[a, b] - c) / max(cx, 1), (one[b] - one_held[b]) / max(kept, 1)] += c
    rows = np.array([(b, c, x, y, 1 / (size + 1)) for (b, x, y), c in events.items()]).reshape(-1, 5)
    w = lm._mixed(rows, plan.rounds)
    out = []
    for i, x in low:
        base = sum(math.log10((one[b] + 1) / (n + size + 1)) for b in x)
        score = 0.0
        for a, b in grams(x):
            v = w[int(math.log2(max(one[a], 1)))]
            score += math.log10(v[0] * two[a, b] / max(one[a], 1) + v[1] * one[b] / max(n, 1) + v[2] / (size + 1))
        out.append((i or 0, len(x), sum(one[b] > 0 for b in x), base, score))
    return sorted(out), w, n


@pytest.mark.parametrize("plan", [lm.Plan(), lm.Plan(listed=40, head=8, entries=500), lm.Plan(listed=0, head=4), lm.Plan(listed=300, head=500, held=3)])
def test_language_model_against_brute_force(spark, rows, plan, tmp_path):
    """Every word and bigram counts as it is, whatever is numbered, in the matrix, or counted in one place."""
    rng = random.Random(12)
    docs = [*rows, *((1000 + k, " ".join(f"r{k}q{j % 3}" if j % 2 else f"a{rng.randrange(5)}" for j in range(40))) for k in range(60)), (5000, "never seen here a1 a2"), (5000, "a0 a1"), (None, "a1 a1 a1")]
    table(spark, docs).withColumn("k", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    trained = lambda i: i is not None and i != 5000 and i % 7 != 2
    keys = [(r.doc_id, r.text, r.k, r.h) for r in t.select("doc_id", "text", "k", (F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(plan.held)) == 0).alias("h")).collect()]
    want, w, n = brute_model([(i, x) for i, x, _, _ in keys], trained, plan, {k for k, (i, _, _, h) in enumerate(keys) if h})
    out, model = lm.scored(t, (F.col("doc_id") != 5000) & (F.col("doc_id") % 7 != 2), plan)
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in out.collect())
    assert model.total == n and 0 < model.held < n
    assert np.allclose(model.weights, w, atol=0.01)  # events in cells of a quarter of a power of two
    assert [g[:3] for g in got] == [x[:3] for x in want]
    assert np.allclose([g[3] for g in got], [x[3] for x in want]) and np.allclose([g[4] for g in got], [x[4] for x in want], rtol=0.01)
    assert sum(g[4] for g in got) > sum(g[3] for g in got)


def test_store_sees_damage(spark, tmp_path):
    """A document that is lost from the recipes, though every other one is whole, and one whose recipe is another's."""
    path, recipes = str(tmp_path / "s"), store.RECIPES
    store.write(table(spark, [(k, f"text number {k} of a few") for k in range(20)]), path, public.path("word_bpe_49k.json"))
    store.verify(spark, path)
    whole = spark.read.schema(recipes).parquet(f"{path}/recipes")
    other = whole.where("doc_id = 3").select("root", "chunks", "sizes").first()
    swapped = [(*r[:3], *(other if r.doc_id == 4 else r[3:6]), r.part) for r in whole.collect()]
    for name, rows in (("lost", [r for r in swapped if r[0] not in (4, 11)]), ("swapped", swapped)):
        damaged = str(tmp_path / name)
        spark.createDataFrame(rows, recipes).write.parquet(f"{damaged}/recipes")
        for kept in ("blocks", "manifest"):
            shutil.copytree(f"{path}/{kept}", f"{damaged}/{kept}")
        with pytest.raises(ValueError, match="manifest"):
            store.read(spark, damaged)


def test_store(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    more = [*rows, (201, "a\x0bb\x0cc\x1cd e\u00a0f  \u0301g"), (202, "STRASSE ÉTÉ İ ǅ x\u0301"), (200, "It's 10,000.5!? <|endoftext|> <|ENDOFTEXT|> don't é .x ...y a.b")]
    store.write(table(spark, more), str(tmp_path / "s"), path)
    whole = Tokenizer.from_file(path)
    want = {}
    for i, t in more:
        want[i] = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
    got = store.read(spark, str(tmp_path / "s")).collect()
    assert len(got) == len(more)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = want[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, np.uint32).tobytes()))
        at += len(ids)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert {r.doc_id: list(r.ids) for r in store.ids(spark, str(tmp_path / "s")).collect()} == want


def test_crc_of_a_concatenation():
    parts = [b"abc", b"", b"x" * 1000, b"yz"]
    assert store.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    rude = ["grobian", "grobling", "Grobik", "trottelix"]
    docs, labels = [], []
    for k in range(900):
        w = [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}n" for _ in range(rng.randint(5, 60))]
        y = int(k % 3 == 0)
        if y:
            w[rng.randrange(len(w))] = rng.choice(rude)
        docs.append((k, " ".join(w)))
        labels.append((k, y))
    docs += [(2000, None), (2001, ""), (None, "x")]
    t, marks = table(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(t, toxicity.fit(toxicity.sample(t, marks))).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, dict(labels)[r.doc_id]) for r in got if r.doc_id in dict(labels) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_empty_tables(spark, tmp_path):
    empty, some = table(spark, []), table(spark, [(1, "a b c"), (2, None)])
    net = toxicity.fit(toxicity.sample(empty, spark.createDataFrame([], "doc_id long, toxic int")))
    assert toxicity.score(some, net).count() == 2 and toxicity.score(empty, net).count() == 0
    assert {(r.n_known, r.score) for r in lm.scored(some, F.lit(False))[0].collect()} == {(0, 0.0)}
    assert lm.scored(empty, F.lit(True))[0].count() == 0
    store.write(empty, str(tmp_path / "s"), public.path("word_bpe_49k.json"))
    assert store.read(spark, str(tmp_path / "s")).count() == 0
    assert bpe.digests(empty, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() == 0


def test_few_rows_go_to_few_tasks(spark):
    """However many shuffle partitions a session has, tables and Python tasks of op4 are as many as their rows are worth."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        edges = spark.createDataFrame([(k, k - 1) for k in range(1, 9)], "u long, v long")
        found = components.components(edges)
        assert len(found.inputFiles()) <= common.TASKS and {tuple(r) for r in found.collect()} == {(k, 0) for k in range(1, 9)}
        texts = [(k, " ".join(f"w{j}" for j in range(30) if j != k)) for k in range(40)]
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        held = neardup._held(docs, pairs := common.staged(docs.selectExpr("0L AS a", "doc_id AS b").where("b > 0"), "pairs"))
        assert len(held.inputFiles()) <= common.TASKS
        links = neardup.confirmed(pairs, held, neardup.Plan())
        assert links.rdd.getNumPartitions() <= common.TASKS
        assert common.gathered(spark.range(0, 100, 1, 90), 100 * common.ROWS).rdd.getNumPartitions() == 90
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
