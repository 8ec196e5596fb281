"""Models and packing over whole small tables, worked out again without the library's steps; columns with clashing names; labels that must not be learned."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import public_tokenizers
from mktlens.llm import bpe, exact_dedup, html_text, language_id, near_dedup, neighbours, packing, periodic_runs, quality, secrets, spelling, substring_dedup, toxicity
from mktlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def fold(doc_id, every):
    return zlib.crc32(str(doc_id).encode()) % every


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def hashed(values):
    return mixed(sum(v * pow(0x9E3779B97F4A7C55, k, 1 << 64) for k, v in enumerate(values)) & MASK)


BYTE = [mixed((b + 1) * 0x9E3779B97F4A7C15 & MASK) for b in range(256)]


def buckets(text):
    """op6's features: words, pairs of words and 2 to 4 characters, white space among them."""
    split = lambda s: [w for w in re.split("[ \t-\r]+", s) if w]
    words = [hashed(BYTE[b] for b in w.encode()) for w in split(text)]
    kinds = [words, [hashed(pair) for pair in zip(words, words[1:])]]
    kinds += [[hashed(BYTE[b] for b in text[k : k + n].encode()) for k in range(len(text) - n + 1)] for n in (2, 3, 4)]
    return [(h + k & MASK) % quality.BUCKETS for k, found in enumerate(kinds) for h in found]


def trained(rows, seed=0):
    """Stochastic gradient descent one feature at a time."""
    share, rng = sum(label for _, label in rows) / len(rows), np.random.default_rng(seed)
    docs = [(Counter(buckets(text)), label) for text, label in rows]
    size = quality.DIMENSIONS
    vectors = rng.uniform(-1 / size, 1 / size, (quality.BUCKETS, size))
    output, bias = np.zeros((size, 2)), np.log([1 - share, share])
    for done, k in enumerate(k for _ in range(quality.EPOCHS) for k in rng.permutation(len(docs))):
        found, label = docs[k]
        total, rate = found.total(), quality.RATE * (1 - done / (quality.EPOCHS * len(docs)))
        hidden = sum(vectors[b] * n / total for b, n in found.items())
        z = np.array([math.exp(x) for x in hidden @ output + bias])
        wrong = z / z.sum() - np.eye(2)[label]
        back = output @ wrong
        output = output - rate * np.outer(hidden, wrong)
        bias = bias - 0.1 * rate * wrong
        for b, n in found.items():
            vectors[b] -= rate * min(1000 * n / total, 20) * back
    return vectors @ (output[:, 1] - output[:, 0]), bias[1] - bias[0]


def test_quality_by_hand(spark, texts):
    rows = [(texts[i] or "", int(i % 3 > 0)) for i in sorted(texts)[:12]] + [("ÀÉ 漢字 x", 1), ("zz", 0)]
    model, (logits, constant) = quality.fit(rows), trained(rows)
    assert np.abs(model.logits - logits).max() < 1e-3 and abs(model.constant - constant) < 1e-3
    some = {i: texts[i] for i in sorted(texts)[:60]} | {-1: None, -2: "", -3: "ß", -4: "a b", -5: "é\t漢 "}
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(list(some.items()), "doc_id long, text string"), model).collect()}
    for i, text in some.items():
        found = buckets(text or "")
        z = constant + (sum(logits[b] for b in found) / len(found) if found else 0)
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-3, i


def grams(text):
    """Three classes each: letters of ASCII without case, other bytes, and the rest of ASCII as one."""
    kind = [1 + (b | 0x20) - 0x61 if chr(b).isascii() and chr(b).isalpha() else 27 + (b - 0x80) % 37 if b >= 0x80 else 0 for b in text.encode()]
    return [g for g in zip(kind, kind[1:], kind[2:]) if g != (0, 0, 0)]


def test_language_by_hand(spark, texts):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    counts = defaultdict(Counter)
    for r in rows:
        if fold(r["doc_id"], 4) != 2 and r["text"] is not None and r["lang"] is not None:
            counts[r["lang"]].update(grams(r["text"]))
    langs, size = sorted(counts), 64**3
    assert 2 < len(langs) <= 5
    # a split of the languages is a classifier; the first language is on the side of 1
    splits = [[-1 if k and b >> (k - 1) & 1 else 1 for k in range(len(langs))] for b in range(1, 2 ** (len(langs) - 1))]
    seen = set().union(*counts.values())
    share = {lang: {g: (counts[lang][g] + 0.05) / (counts[lang].total() + 0.05 * size) for g in seen} for lang in langs}
    rare = {lang: 0.05 / (counts[lang].total() + 0.05 * size) for lang in langs}
    ratio = lambda split, of: math.log(np.mean([of(x) for x, s in zip(langs, split) if s > 0]) / np.mean([of(x) for x, s in zip(langs, split) if s < 0]))
    weights = [{g: ratio(split, lambda x, g=g: share[x][g]) for g in seen} for split in splits]
    unseen = [ratio(split, rare.get) for split in splits]
    sure = []
    for k, lang in enumerate(langs):
        rest = 1 - sum(share[lang].values()) - rare[lang]  # what all unseen trigrams have; the one of no letters has no weight
        margins = [sum(share[lang][g] * w[g] for g in seen) + rest * u for w, u in zip(weights, unseen)]
        sure.append([1 / (1 + math.exp(-language_id.STEEP * m * split[k])) for m, split in zip(margins, splits)])
    got = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, SF).collect()}
    assert set(got) == set(texts) and len(rows) == len(got)
    for i, text in texts.items():
        assert got[i]["held_out"] == (fold(i, 4) == 2)
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        n = max(len(text.encode()) - 2, 1)
        margins = [sum(w.get(g, u) for g in grams(text)) / n for w, u in zip(weights, unseen)]
        loss = [sum(t * math.log1p(math.exp(-language_id.STEEP * m * split[k])) for t, m, split in zip(sure[k], margins, splits)) / sum(sure[k]) for k in range(len(langs))]
        assert got[i]["lang_pred"] == langs[int(np.argmin(loss))]
        assert abs(got[i]["score"] - math.exp(-language_id.SHARP * min(loss)) / sum(math.exp(-language_id.SHARP * x) for x in loss)) < 1e-3


def test_toxicity_by_hand(spark, texts):
    """Bytes saved word by word, thresholds by counting, and weights at which the penalised likelihood is greatest."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learn = sorted(i for i, label in labels.items() if label is not None and texts[i] is not None and fold(i, 3) != 1)
    rows = [(texts[i], int(labels[i])) for i in learn]
    model = toxicity.fit(rows)
    carrier = bytes([*range(0x80, 0xC0), *range(0xC0, 0x80, -1)])
    level = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=8)

    def length(content, word):
        known = zstandard.ZstdCompressionDict(content + carrier, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(compression_params=level, dict_data=known).compress(b" " + word.encode() + b" " + carrier))

    seen = {}

    def distance(word):
        if word not in seen:
            parts, run = [], ""
            for c in word.lower() + " ":
                if c.isalpha():
                    run += c
                elif run:
                    parts, run = [*parts, run], ""
            seen[word] = max([0, *(length(model.ordinary, p) - length(model.toxic, p) for p in parts)])
        return seen[word]

    far = [0, *(distance(w) for text, label in rows if not label for w in set(text.split()))]
    assert len(model.steps) == len(toxicity.BEYOND)
    for least, share in zip(model.steps, toxicity.BEYOND, strict=True):
        assert sum(d >= least for d in far) <= share * len(far) and (least == 1 or sum(d >= least - 1 for d in far) >= share * len(far))

    def features(text):
        found = [distance(w) for w in (text or "").split()]
        beyond = [math.log1p(sum(d >= least for d in found)) for least in model.steps]
        return [1, min(max(found, default=0), 8), *beyond, *(b / math.log(2 + len(found)) for b in beyond)]

    chance = lambda text: 1 / (1 + math.exp(-float(np.dot(features(text), model.weights))))
    slope = sum((chance(text) - label) * np.array(features(text)) for text, label in rows) + np.r_[0, np.ones(len(model.weights) - 1)] * model.weights
    assert np.abs(slope).max() < 1e-3
    got = {r["doc_id"]: r for r in QUERIES["op2_toxicity"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        found = [distance(w) for w in (text or "").split()]
        assert abs(got[i]["score"] - chance(text)) < 1e-6 and got[i]["held_out"] == (fold(i, 3) == 1) and got[i]["predicted"] == (chance(text) >= 0.7)
        assert (got[i]["farthest"], got[i]["n_far"]) == (max(found, default=0), sum(d >= model.steps[1] for d in found))


def test_held_out_labels_are_not_learned(spark, tmp_path):
    """Other labels, languages and sources of the rows held out change no score."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = lambda every, rest: F.crc32(F.col("doc_id").cast("string")) % every == rest
    docs.withColumn("lang", F.when(out(4, 2), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.select("doc_id", *(F.when(out(3, 1), 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("toxic", "quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    for query in ("op2_toxicity", "op6_quality_classifier", "op9_language_id"):
        one, two = (sorted(map(str, QUERIES[query](spark, folder).collect())) for folder in (SF, str(tmp_path)))
        assert one == two, query


def test_packing_of_documents(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    library.no_truncation()
    library.no_padding()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    places, of_doc = defaultdict(list), defaultdict(list)
    for r in QUERIES["op4_best_fit_packing"](spark, SF).collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        of_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert {i: sorted(found) for i, found in of_doc.items()} == {i: [(k, 4096 * k, min(4096, len(x) - 4096 * k)) for k in range(-(-len(x) // 4096))] for i, x in ids.items()}
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(map(len, ids.values())) // 4096)
    assert least <= len(places) <= least + 1


#: Names that operators use for columns of their own.
CLASHING = """ agree anchor at block bucket char_class component_id crowded decoded family form form_n found group_size hash held_out html_text ids ids_crc32 keep_id kept kept_sha256 key kind label lang_pred least length
 n n_near n_removed n_shingles n_tokens node offset partition piece position predicted rank root row score sequence_id set shard share size sketch slack spans start stop text_a text_sha256 token tokens word words""".split()


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{k % 97}x" for k in range(3000))
    common = [(k, f"{'organisation' if k % 6 else 'organization'} of the committee number{k % 4} and so on it goes in this long line of text") for k in range(20, 50)]
    rows = [(1, "the cat sat on the mat and the dog ran off"), (2, "the cat  sat on\tthe mat and the dog ran off"), (3, None), (4, ""), (5, " \n "), (6, long), (7, long + " end"), (8, "token = abcdefgh é"), (9, "go on " * 40), *common]
    return spark.createDataFrame(rows, "doc_id long, text string")


TOKENS = bpe.vocabulary_text(WORDS)
OPERATORS = {
    "1": lambda d: substring_dedup.substring_dedup(d, 3),
    "2": lambda d: toxicity.score(d, toxicity.fit([("good day", 0), ("bad scum", 1)] * 8)),
    "3": secrets.find_secrets,
    "4": lambda d: packing.pieces(d, TOKENS),
    "5": lambda d: bpe.decode(bpe.encode(d, TOKENS), TOKENS),
    "6": lambda d: quality.score(d, quality.fit([("good day", 0), ("bad scum", 1)] * 8)),
    "7": near_dedup.near_groups,
    "8": exact_dedup.exact_dedup,
    "8 rows": exact_dedup.without_copies,
    "9": lambda d: language_id.identify(d, language_id.fit(d.where("text is not null").select("text", F.when(F.col("doc_id") < 20, "a").otherwise("b").alias("lang")))),
    "11": periodic_runs.periodic_runs,
    "13": spelling.spelling_variants,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(odd, name):
    more = odd.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))
    plain = OPERATORS[name](odd)
    got = OPERATORS[name](more)
    chosen = plain.columns if name != "8 rows" else odd.columns
    assert sorted(map(str, got.select(*chosen).collect())) == sorted(map(str, plain.select(*chosen).collect()))
    if name == "8 rows":
        assert got.columns == more.columns and all(r["token"] == f"token{r['doc_id']}" for r in got.collect())


def test_clashing_columns_of_pages_and_vectors(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    more = lambda df, key: df.select("*", *(F.concat(F.lit(c), F.col(key).cast("string")).alias(c) for c in CLASHING if c not in df.columns))
    of = lambda df: sorted(map(str, df.collect()))
    chosen = [c for c in html_text.html_extraction(pages).columns if c not in CLASHING]
    assert of(html_text.html_extraction(more(pages, "page_id")).select(*chosen)) == of(html_text.html_extraction(pages).select(*chosen))
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = [neighbours.nearest(df, df.where("vec_id % 100 = 0")) for df in (vectors, more(vectors, "vec_id"))]
    assert found[0].columns == found[1].columns and of(found[0]) == of(found[1])
