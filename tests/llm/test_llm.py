"""Each operator against a plain version, on sample data and on awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import decontamination, language_id, licences, mixing, ngram_join, quality_model, quality_rules, sharding, suffix_dedup, window_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target double, row long, _size string, token string, _gone int"


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in data) if lower else data)


def awkward():
    """Nulls in any column, blanks, repeated rows, a family of near copies, a chain of links, long and periodic texts."""
    base = [f"w{k}" for k in range(60)]
    texts = [None, "", " \n\t ", "one", "one", "ONE", "a b c d", "a b c d", "x" * 5000, "ab " * 3000, "\n".join(["same line here"] * 40), "é ü 漢字 " * 30, "# * $ | " * 80]
    for k in range(30):  # near copies of one text, each with its own change
        texts.append(" ".join([*base[: k * 2], f"new{k}", *base[k * 2 + 1 :]]))
    texts += [" ".join(base[s : s + 55]) for s in range(0, 6)] + [" ".join(base)] * 4
    rng = np.random.default_rng(3)
    long = " ".join(f"t{x}" for x in rng.integers(0, 400, 30_000))
    texts += [long, long + " tail", "lead " + long[:4000]]
    passage = " ".join(f"p{k}" for k in range(70))
    texts += [" ".join(f"u{d}x{k}" for k in range(40)) + " " + passage + " " + " ".join(f"v{d}x{k}" for k in range(40)) for d in range(12)]
    langs, sources = ["en", None, "de"], ["s1", None, "s2", "é"]
    rows = [(k, t, langs[k % 3], sources[k % 4], None, 0.5, k, "7", "tok", 1) for k, t in enumerate(texts)]
    return [*rows, rows[15], rows[20], rows[20], (None, "one two three four five six seven", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def sample(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---- 1: similarity join ---------------------------------------------------------------

def plain_components(rows):
    sets = []
    for d, t in rows:
        w = words(t, True)
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=str)


@pytest.mark.parametrize("name", ["odd", "sample"])
def test_join(name, request):
    docs = request.getfixturevalue(name)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs).collect()), key=str)
    assert got == plain_components(pairs(docs))


def test_long_words_are_told_apart(spark):
    """A Thue-Morse word and its complement, which a polynomial modulo 2**64 takes for one another."""
    bits = [0]
    for _ in range(10):
        bits += [1 - b for b in bits]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    tail = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"{one} {tail}"), (4, f"{other} {tail}")], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.components(docs.where("doc_id < 3")).collect()} == {1, 2}
    assert {r["doc_id"]: r["n_removed"] for r in window_dedup.digest(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 60}


def test_deduplicated_keeps_one_of_each(odd, empty):
    kept = ngram_join.deduplicated(odd)
    least = {d for d, _, c in plain_components(pairs(odd)) if d == c}
    assert {r["doc_id"] for r in kept.collect()} == {*least, None} and kept.columns == odd.columns
    assert ngram_join.components(empty).count() == 0


# ---- 2, 9, 10: models and rules ----------------------------------------------------------

def test_quality(spark, data, sample, odd, empty):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_model.scored(sample, labels).collect()}
    assert len(got) == sample.count() and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    held = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [s for q, s in held if q], [s for q, s in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.8
    assert quality_model.scored(odd, labels).count() == odd.count() and quality_model.scored(empty, labels.limit(0)).count() == 0


def test_quality_fit_is_row_by_row(spark, sample):
    """Counts of bins that occur together against rows; the fit from counts against the same steps over rows; clashing names."""
    rows = quality_model.measured(sample)
    x = np.array([r["x"] for r in rows.collect()])
    cells = np.bincount((quality_model._cell(x) + np.arange(x.shape[1]) * quality_model.CELLS).ravel(), minlength=x.shape[1] * quality_model.CELLS)
    at = quality_model.edges(cells)
    own = quality_model.bins(x, at)
    z = np.zeros((len(x), x.shape[1] * quality_model.BINS + 1))
    np.put_along_axis(z, own, 1, 1)
    together = quality_model._together(rows, at)
    assert np.array_equal(together, (z.T @ z).astype(np.int64))
    trusted, prior = z[::3], 0.6
    w, m, v = np.append(np.zeros(z.shape[1] - 1), prior), 0, 0
    for step in range(1, 41):
        gu, gp = z @ w, trusted @ w
        if (gu**2).mean() - prior * (gp**2).mean() >= 0:
            slope = 2 * (prior * (trusted.T @ (gp - 1)) / len(trusted) + z.T @ gu / len(z) - prior * trusted.T @ gp / len(trusted))
        else:
            slope = -2 * (z.T @ gu / len(z) - prior * trusted.T @ gp / len(trusted))
        slope = slope + quality_model.PENALTY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - 0.02 * (1 - step / 41) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    steps, quality_model.STEPS = quality_model.STEPS, 40
    try:
        assert np.allclose(quality_model.fit(together, (trusted.T @ trusted).astype(np.int64), prior), w, atol=1e-6)
    finally:
        quality_model.STEPS = steps
    clash = spark.createDataFrame([(1, "a b c", 3, 1.0), (2, None, 3, 1.0), (2, None, 3, 1.0)], "doc_id long, text string, _id int, x double")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality_model.scored(clash, labels).count() == 3


def test_risk_bound_is_exact():
    for k, n in ((0, 50), (3, 100), (7, 7)):
        p = quality_rules.binomial_upper(k, n, 0.05)
        draws = np.random.default_rng(1).binomial(n, min(p, 1 - 1e-12), 200_000)
        assert p == 1 or abs((draws <= k).mean() - 0.05) < 0.005


def test_rules(spark, data, sample, odd, empty):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    for docs in (sample, odd):
        want = collections.Counter()
        for d, t in pairs(docs):
            w, lines = words(t), (t or "").split("\n")
            tri = collections.Counter(zip(w, w[1:], w[2:]))  # noqa: B905
            marked = {i + o for i, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for o in range(3)}  # noqa: B905
            seen, dup = set(), 0
            for line in lines:
                if words(line):
                    dup += line in seen
                    seen.add(line)
            want[d, len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)] += 1
        got = quality_rules.judged(docs, labels).collect()
        assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == want
        assert all(not r["kept"] for r in got if r["base_failed"]) and all(r["kept"] or r["base_failed"] or r["rejected_by"] for r in got)
    assert quality_rules.judged(empty, labels).count() == 0


def test_kept_against_trying_each_step(spark):
    """Cutoffs and verdicts by brute force: each step tested with sums of binomial terms, in order, until one fails."""
    import math

    rng = np.random.default_rng(11)
    rows = []
    for k in range(1600):
        lang = ["en", "de", None][k % 3] if k % 8 else "fr"
        text = " ".join(f"w{k}x{j}" for j in range(60)) + " #" * int(rng.choice([0, 0, 0, 4, 9, 16, 24, 40], p=[0.3, 0.3, 0.3, 0.04, 0.02, 0.02, 0.01, 0.01]))
        rows.append((k, text + "\n" + "same line of words\n" * int(rng.choice([0, 1, 3], p=[0.97, 0.02, 0.01])), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = {k for k in range(1600) if k % 7}
    labels = spark.createDataFrame([(k, int(k in good)) for k in range(1500)], "doc_id long, quality int")
    counts = {r["doc_id"]: r.asDict() for r in quality_rules.measured(docs).collect()}
    ratio = lambda r, rule: r[quality_rules.RULES[rule][0]] / max(1, r[quality_rules.RULES[rule][1]])
    fails = lambda r, cuts: any(ratio(r, rule) > c for rule, c in cuts.items())
    base = lambda r: r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]
    strata = {lang for _, _, lang in rows}
    found = {}
    for lang in strata:
        hold = [r for d, r in counts.items() if r["lang"] == lang and d in good and d < 1500 and not base(r)]
        found[lang] = {}
        for step in range(quality_rules.STEPS):
            cuts, n = quality_rules.step_cutoffs(step), len(hold)
            f = sum(fails(r, cuts) for r in hold)
            if f >= quality_rules.RISK * n or sum(math.comb(n, j) * quality_rules.RISK**j * (1 - quality_rules.RISK) ** (n - j) for j in range(f + 1)) > quality_rules.DELTA / len(strata):
                break
            found[lang] = cuts
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, labels).collect()}
    assert got == {d: not base(r) and not fails(r, found[r["lang"]]) for d, r in counts.items()}
    assert any(found.values()) and not all(got.values())


def test_thresholds_need_evidence(spark, sample):
    """With many good documents a cutoff is found; with few none is."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(60)) + " #" * (30 if k % 500 == 0 else 0), "en") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    all_good = docs.select("doc_id", F.lit(1).alias("quality"))
    got = quality_rules.judged(docs, all_good)
    assert got.where("not kept").count() == 3 and quality_rules.judged(docs, all_good.limit(50)).where("not kept").count() == 0


def test_language(sample, odd, empty):
    got = {r["doc_id"]: r for r in language_id.identified(sample).collect()}
    held = [(r["lang"], got[r["doc_id"]]["lang_pred"]) for r in sample.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.9
    marks = {r["doc_id"]: r for r in language_id.identified(odd).collect()}
    assert all(marks[k]["lang_pred"] == "und" and marks[k]["score"] == 0 for k in (0, 1, 2, 12)) and marks[3]["lang_pred"] != "und"
    assert {r["doc_id"] for r in language_id.accepted(odd).collect()} <= set(marks) and language_id.accepted(odd).columns == odd.columns
    assert language_id.identified(empty).count() == 0
    signs = odd.sparkSession.createDataFrame([(k, t, ("en", "de")[k % 2], 5, "x") for k, t in enumerate(["the cat and the dog", "der hund und die katze"] * 20 + ["\u00b2 \u00bd", "4\u00b2 _ !", "\u00e9"])], "doc_id long, text string, lang string, id int, language string")
    said = {r["doc_id"]: r["lang_pred"] for r in language_id.identified(signs).collect()}
    assert said[40] == said[41] == "und" != said[42] and language_id.accepted(signs).columns == signs.columns
    unlearned = language_id.identified(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlearned.collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 3, 5, 12])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert min(apart) >= (1 if n < 3 else 2)


# ---- 3, 7: shards and mixes ------------------------------------------------------------------

def plain_capacity(sizes, shards):
    def fits(c):
        n, room = 1, c
        for x in sizes:
            if x > c:
                return False
            if x > room:
                n, room = n + 1, c
            room -= x
        return n <= shards

    return next(c for c in range(max(sizes, default=0), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("name", ["odd", "sample"])
def test_shards(name, request):
    docs = request.getfixturevalue(name)
    rows = sharding.sharded(docs).collect()
    text = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(docs))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == text
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in part) == list(range(len(part))) for part in by.values()) and set(by) <= set(range(8))
    groups = collections.Counter()
    for _, t in pairs(docs):
        groups[hashlib.md5(b"null text" if t is None else t.encode()).hexdigest()] += len((t or "").encode()) + 1
    assert max(sum(r["size"] for r in part) for part in by.values()) == plain_capacity([n for _, n in sorted(groups.items())], 8)
    placed = collections.defaultdict(set)
    for (d, t), r in zip(sorted(pairs(docs), key=str), sorted(rows, key=lambda r: str(r["doc_id"])), strict=True):
        placed[t].add(r["shard"]) if docs.where("doc_id is null").isEmpty() else None
    assert all(len(s) == 1 for s in placed.values())


def test_null_text_is_a_group_of_its_own(spark):
    docs = spark.createDataFrame([(k, None if k % 2 else "null text") for k in range(40)] + [(None, None)] * 9, "doc_id long, text string")
    rows = sharding.sharded(docs, 2).collect()
    assert len({(r["shard"], r["size"]) for r in rows}) == 2 and all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows))) for k in (0, 1))


def test_minimax_against_trying_all():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = rng.integers(1, 40, rng.integers(1, 30)).tolist()
        c, cuts = sharding.minimax(sizes, 4)
        assert c == plain_capacity(sizes, 4) and cuts[-1] == len(sizes) and all(sum(sizes[a:b]) <= c for a, b in zip([0, *cuts], cuts))  # noqa: B905


def test_empty_shards_and_mix(empty):
    assert sharding.sharded(empty).count() == 0 and mixing.digest(empty).count() == 0 and mixing.mixture(empty).count() == 0


@pytest.mark.parametrize("name", ["odd", "sample"])
def test_mix(name, request):
    docs = request.getfixturevalue(name)
    got, source = mixing.digest(docs).collect(), {}
    sizes, of = collections.Counter(), collections.Counter((d, len(words(t))) for d, t in pairs(docs))
    for r in docs.select("doc_id", "text", "source").collect():
        sizes[r["source"]] += len(words(r["text"]))
        source[r["doc_id"]] = r["source"]
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == of
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, left, target, live = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        full = [s for s in live if share[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            live.remove(s)
    target |= share
    taken, largest = collections.Counter(), max(n for _, n in of)
    for r in got:
        s = source[r["doc_id"]]
        assert abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    mean = sum(sizes.values()) / len(of)  # a source of the sample has but ten documents
    assert all(abs(taken[s] - target[s]) <= (mean if name == "sample" else largest) for s in sizes)
    key = lambda rows: sorted((str(r["doc_id"]), r["taken"]) for r in rows)
    assert key(got) == key(mixing.digest(docs.repartition(3)).collect())


def test_mix_lands_every_source(spark):
    """One source above a block, small ones beside it, very long documents in both."""
    rng, rows = np.random.default_rng(11), []
    for s, (source, n) in enumerate((("s0", 3 * mixing.BLOCK), ("s1", 150), ("s2", 150), ("s3", 150))):
        sizes = [*rng.integers(20, 60, n).tolist(), 4000 if n < mixing.BLOCK else 30_000]
        rows += [(1_000_000 * s + k, "w " * size, source) for k, size in enumerate(sizes)]
    got = mixing.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy(F.floor(F.col("doc_id") / 1_000_000)).agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == len(rows) and all(abs(r["taken"] - r["target"]) < 20 for r in got)


def test_mixture_repeats_whole_rows(odd):
    out = mixing.mixture(odd)
    assert out.columns == odd.columns
    assert sum(len(words(t)) for _, t in pairs(out)) == sum(r["taken"] for r in mixing.digest(odd).collect())


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    sizes, p = rng.integers(1, 1000, 500).astype(float), np.full(500, 0.37)
    out = mixing.fly(p, sizes.tolist(), 1)
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs((out * sizes).sum() - (p * sizes).sum()) < 1e-4 and abs(out.sum() - p.sum()) < 1e-6


# ---- 4: benchmark passages ---------------------------------------------------------------------

def test_passages(spark, data, sample, odd, empty):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.searched(sample, items).collect()}
    assert {(d, i) for d, t in pairs(sample) for i, x in texts.items() if x in t} == got
    item = texts[0]
    edited = item[:30].upper() + item[30:60].replace(" ", "\n  ") + "X" + item[60:90] + item[91:]
    rows = [(1, "lead in " + edited + " and out", None), (2, item[:40], None), (3, None, None), (4, " ".join(reversed(item.split())), None), (5, "é" * 500 + edited, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c0 string")
    hits = decontamination.searched(docs, items).where("item_id = 0").collect()
    assert sorted(r["doc_id"] for r in hits) == [1, 5] and all(r["edits"] <= 3 for r in hits)
    assert sorted(r["doc_id"] for r in decontamination.decontaminated(docs, items).collect()) == [2, 3, 4]
    assert decontamination.searched(odd, items).count() == 0 and decontamination.decontaminated(odd, items.limit(0)).count() == odd.count()
    assert decontamination.searched(empty, items).count() == 0


def test_passages_in_any_case(spark):
    """Upper-cased French, Spanish, German, Greek and Turkish items are found as English ones are."""
    texts = [
        "Les élèves étaient à l'école près de la forêt, où les érables âgés perdent déjà leurs feuilles; le maître répète sa leçon à côté.",
        "El niño pequeño soñó con una montaña lejana; mañana irá también su compañía, según él, a la región más cálida del país vecino.",
        "Die Straße war weiß, und draußen saß ein großer Spieß; dreißig Füße maß er, heißt es, außer am Fluß, wo er bloß süßes aß und genoß.",
        "Ο σοφός δάσκαλος είπε στους μαθητές ότι ο δρόμος είναι μακρύς και οι καιροί δύσκολοι, όμως ο κόπος τους αξίζει πάντα τελικά.",
        "The pupils were at school near the wood, where old maples already shed their leaves, and the teacher repeats the lesson at once.",
    ]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(k, f"ß İ {k} " + x.upper() + " et fin") for k, x in enumerate(texts)], "doc_id long, text string")
    hits = decontamination.searched(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in hits) == [(k, k, 0) for k in range(5)]


def test_folded_offsets():
    texts = ["ßA \n B", "", "ŒUVRE ŉx", "日本 😀Z", None, "ﬃ"]
    import pyarrow as pa

    points, offsets = decontamination.characters(*decontamination._text.raw(pa.array(texts)))
    got = ["".join(map(chr, points[a:b])) for a, b in zip(offsets, offsets[1:])]  # noqa: B905
    assert got == [re.sub(r"\s+", " ", (x or "").casefold()) for x in texts]


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "a rather short item"), (2, "tiny"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here stands A rather  SHORT item, whole"), (2, "a rather short items"), (3, "a rather sort item"), (4, "a rather short item")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.searched(docs, bench).collect()) == [(1, 1), (4, 1)]
    assert sorted(r["item_id"] for r in decontamination.unsearched(bench).collect()) == [2, 3]


def test_excerpts_at_every_offset(data):
    """Of each item, every excerpt of SHORT + STEP - 1 characters is found wherever it begins, and so is one edited in a way that RATE allows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    items = [(k, " ".join(t.split())) for k, t in enumerate(pq.read_table(f"{data}/benchmark.parquet")["text"].to_pylist()[:3])]
    index, n = decontamination.Index(items), decontamination.SHORT + decontamination.STEP - 1
    docs = [(k, t[a : a + n]) for k, t in items for a in range(len(t) - n + 1)]
    edited = [(k, x[:15] + "#" + x[16:33] + "#" + x[34:]) for k, x in docs]
    for cases, most in ((docs, 0), (edited, 2)):
        found = decontamination._matches(index, pa.array([f"{d} before it {x} and after {d}" for d, (_, x) in enumerate(cases)]))
        assert all(found.get((d, k), (9,))[0] <= most for d, (k, _) in enumerate(cases))
    assert not decontamination._matches(index, pa.array([t[:40] for _, t in items]))


def test_equal_halves_of_a_band_add_up():
    """13 q-grams on each side of a half-band's edge are 26, and 25 are asked for."""
    item = "".join(chr(0x4E00 + k) for k in range(96))
    index = decontamination.Index([(7, item)])
    for lead in range(2 * index.edits[0] + 2):
        text = "-" * lead + item[:24] + "-" * 7 + item[30:54]
        points = np.array([ord(c) for c in text], np.uint32)
        assert 0 in {c for _, c, _ in index.candidates(points, np.array([0, len(points)]))}, lead


def test_banded_alignment_is_edit_distance():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a = rng.integers(0, 3, 30)
        b = np.concatenate((rng.integers(0, 3, 5), np.delete(np.insert(a, 9, 2), 20), rng.integers(0, 3, 5)))
        row = np.zeros(len(b) + 1, int)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = np.array(new)
        assert decontamination.banded(a, b, -10, 41, 30)[0] == row.min()


# ---- 5, 6: repeated strings ------------------------------------------------------------------------

def plain_suffix(rows, width=200):
    data = [(t or "").encode() for _, t in rows]
    often = collections.Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if often[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append((d, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("name", "together"), [("odd", 1 << 18), ("odd", 3000), ("odd", 1), ("sample", 1 << 18)])
def test_repeated_bytes(name, together, request):
    docs = request.getfixturevalue(name)
    got = suffix_dedup.digest(docs, together=together).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_suffix(pairs(docs))


def test_run_index():
    rng = np.random.default_rng(8)
    for _ in range(10):
        unit = rng.integers(0, 3, 40).astype(np.uint8)
        parts = [np.concatenate((rng.integers(0, 3, 5).astype(np.uint8), unit, rng.integers(0, 3, 9).astype(np.uint8))) for _ in range(6)] + [np.zeros(30, np.uint8)]
        index, at = suffix_dedup.RunIndex(parts), 0
        deep = index.matches()
        whole = [bytes(p) for p in parts]
        for k, p in enumerate(whole):
            for i in range(len(p)):
                best = max((next((n for n in range(min(len(p) - i, len(q) - j), 0, -1) if p[i : i + n] == q[j : j + n]), 0) for m, q in enumerate(whole) for j in range(len(q)) if (m, j) != (k, i)), default=0)
                assert deep[at + i] == best
            at += len(p) + 1
        assert index.runs < len(index.text)


def plain_windows(rows, width=50):
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", ["odd", "sample"])
def test_repeated_windows(name, request):
    docs = request.getfixturevalue(name)
    assert sorted((tuple(r) for r in window_dedup.digest(docs).collect()), key=str) == plain_windows(pairs(docs))


def test_nothing_repeated_in_nothing(empty):
    assert suffix_dedup.digest(empty).count() == 0 and window_dedup.digest(empty).count() == 0


# ---- 8: licences --------------------------------------------------------------------------------------

def test_licences(odd, sample, empty):
    cases = {
        "Text.\nReleased under the MIT License.": ["MIT"], "licensed under the Apache  License, Version 2.0": ["Apache-2.0"], "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "Licensed under CC BY-NC 4.0.\nAll rights reserved.": ["CC-BY-NC-4.0", "Proprietary"], "a license to drive": [], None: [], "": [],
        "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n": ["Apache-2.0"],
    }
    assert {k: licences.recognised(k)[0] for k in cases} == cases
    got = {r["doc_id"]: r["licences"] for r in licences.scanned(sample).collect()}
    for d, t in pairs(sample):
        for phrase, name in (("Released under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0")):
            assert (name in got[d]) == any(line.endswith(phrase) and len(line) == len(phrase) for line in t.split("\n")) or phrase in t
    assert licences.scanned(odd).count() == odd.count() and licences.scanned(empty).count() == 0


ORIGINALS = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful.\n\nYou should have received a copy of the GNU General Public License along with this program.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


@pytest.mark.parametrize("wrap", ["", "\n", "\n# ", "\r\n * "])
def test_licences_from_their_own_words(wrap):
    import textwrap

    texts = {**ORIGINALS, "BSD-2-Clause": ORIGINALS["BSD-3-Clause"].split("\n\n3.")[0]}
    if wrap:
        texts = {k: (wrap * 2).join(wrap.join(textwrap.wrap(part, 60)) for part in t.split("\n\n")) for k, t in texts.items()}
    assert {k: licences.recognised("Some words before.\n\n" + t + "\n\nSome words after.")[0] for k, t in texts.items()} == {k: [k] for k in texts}
    ids = {name for t in texts.values() for name in licences.recognised(t)[1]}
    assert ids >= {"mit.grant", "mit.notice", "apache2.under_the", "apache2.may_not", "apache2.copy", "gpl.free", "gpl.copy", "mpl2.form", "mpl2.copy", "bsd.endorse", "isc.grant", "unlicense"}


def test_every_licence_sentence_and_rule():
    titles = {name: text for text, name in licences.TITLES.items()}
    known = {**licences.SENTENCES, **titles}
    for name, text in known.items():
        for case in (text, text.upper(), text.replace(" ", "\n", 5) if name in licences.SENTENCES else text):
            assert licences.recognised("Before this.\n\n" + case + ".\nAfter")[1] == [name], name
    for licence, names in licences.RULES:
        assert licences.recognised("\n\n".join(known[n] + "." for n in names))[0] == [licence], names
    cases = {
        "This project is licensed under the MIT License, see below": ["MIT"], "MIT License\n\nCopyright (c) 2020 A": ["MIT"], "unlike the MIT License it is long": [], "It is not licensed under the MIT License.": [],
        "Apache License\n    Version 2.0, January 2004": ["Apache-2.0"], "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007": ["GPL-3.0"], "Licensed under the GNU General Public License, version 3 or later.": ["GPL-3.0-or-later"], "relicensed under the MIT Licenses": [],
    }
    assert {k: licences.recognised(k)[0] for k in cases} == cases


# ---- the pipeline ------------------------------------------------------------------------------------------

def test_pipeline(spark, data, sample):
    import corpus_pipeline

    docs, kept = sample, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        kept.append({r["doc_id"] for r in out.select("doc_id").collect()})
        docs = out
    known = {r["doc_id"] for r in language_id.identified(sample).where("lang_pred <> 'und' and not ambiguous").collect()}
    assert kept[0] == known
    after = sample.where(F.col("doc_id").isin(sorted(known)))
    assert kept[1] == {d for d, _, c in plain_components(pairs(after)) if d == c}
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert kept[2] == {d for d, t in pairs(sample.where(F.col("doc_id").isin(sorted(kept[1])))) if not any(i in t for i in items)}
    result = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in result} <= kept[2] and {r["shard"] for r in result} <= set(range(8))
    n = collections.Counter(r["doc_id"] for r in result)
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.digest(sample.where(F.col("doc_id").isin(sorted(kept[2])))).collect() if r["size"]}
    assert all(n[d] == k for d, k in taken.items())
