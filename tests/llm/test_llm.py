import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, html_text, mixing, near_dedup, sharding, substring_dedup, token_counts, token_files, toxicity
from lodestone.llm.scratch import CLEANUP, Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, id string"
PICK = random.Random(5)
VOCABULARY = ["".join(PICK.choice("abcdefghé") for _ in range(PICK.randint(1, 7))) for _ in range(400)]


def prose(n):
    return " ".join(PICK.choice(VOCABULARY) for _ in range(n))


PASSAGE, LONG = prose(80), prose(6000)
TEXTS = [None, "", " \n ", "one", "one two", "One Two", LONG, LONG + " tail", *[prose(30) + " " + PASSAGE + " " + prose(30) for _ in range(5)]]
BASE = prose(200)
for _k in range(8):
    _w = BASE.split()
    _w[PICK.randrange(200)] = "changed"
    TEXTS.append(" ".join(_w))
TEXTS += [BASE, BASE.upper(), BASE] + [prose(PICK.randint(1, 60)) for _ in range(20)]


def rows():
    return [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, True, "x") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def split(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_exact(docs, nothing):
    got = by_id(exact_dedup.exact_dedup(docs, keep="largest"))
    for i, t in enumerate(TEXTS):
        same = [j for j, u in enumerate(TEXTS) if fold(u) == fold(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256(fold(t).encode()).hexdigest()
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert by_id(exact_dedup.exact_dedup(docs))[0]["keep_id"] == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups_of_any_size_and_odd_ids(spark, keep):
    rows = [(i, f"text {i % 7}" if i % 3 else "Hot") for i in range(300)]
    rows += [(None, "hot"), (None, "alone"), (None, "Alone"), (5, "twice"), (5, "twice"), (-3, None), (-4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t or ""), []).append(i)
    best = {"smallest": min, "largest": max}[keep]
    want = []
    for i, t in rows:
        ids = groups[fold(t or "")]
        survivor = best((x for x in ids if x is not None), default=None)
        want.append((i, survivor, len(ids), i == survivor, hashlib.sha256(fold(t or "").encode()).hexdigest()))
    for large in (0, 20, 1000):  # all groups are looked up by broadcast, the larger ones, none
        got = exact_dedup.exact_dedup(frame, keep=keep, large=large)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_exact_merges_sorted_runs(spark, docs):
    merged = exact_dedup.merge_runs(exact_dedup.digests(docs), runs=16)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Sort [run") == 4 and plan.count("REPARTITION_BY_COL") == 2


def test_saving_leaves_no_shuffle_files(spark):
    def files():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList()
        return sum(".data" in str(blocks.apply(i).getName()) for i in range(blocks.size()))

    scratch, before = Scratch(spark, "tidy"), files()
    wide = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    saved = scratch.save(wide.join(wide.withColumnRenamed("n", "m"), "k"), "wide")
    until = time.monotonic() + 20
    while files() > before and time.monotonic() < until:  # files go in the background
        time.sleep(0.1)
    assert files() <= before and saved.count() == 7
    assert spark.conf.get(CLEANUP) == "false"


def test_near(spark, docs, nothing):
    def shingles(t):
        w = split(fold(t))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in TEXTS]
    parent = list(range(len(TEXTS)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = by_id(near_dedup.near_duplicates(docs))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(TEXTS))] == [(len(s), root(i)) for i, s in enumerate(sets)]
    assert near_dedup.near_duplicates(nothing).count() == 0
    odd = spark.createDataFrame([(None, BASE), (None, None), (3, BASE), (3, BASE)], "doc_id bigint, text string")
    assert sorted((r["id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_dedup.near_duplicates(odd).collect()) == [(-1, -1, True)] * 2 + [(3, 3, True)] * 2


def test_links_between_components_of_a_bucket_are_found(spark):
    """A chain: neighbours are linked, ends aren't, whichever of them heads a bucket."""
    w = [f"w{i}" for i in range(600)]
    chain = [" ".join(w[38 * k : 38 * k + 300]) for k in range(6)]
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(chain)), "doc_id bigint, text string")))
    assert {r["component_id"] for r in got.values()} == {0}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_recall_just_above_the_threshold(spark):
    """Pairs of a similarity of 0.75 to 0.8, each alone, of 30 to 400 words: all are found."""
    pick = random.Random(21)
    pairs, texts = 0, []
    while pairs < 600:
        w = [f"v{pick.randrange(10**6)}" for _ in range(pick.choice([30, 60, 120, 400]))]
        v = list(w)
        for _ in range(pick.randint(1, max(1, len(w) // 30))):
            v[pick.randrange(len(v))] = f"u{pick.randrange(10**6)}"
        if 0.75 <= jaccard(*({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (w, v))) <= 0.8:
            texts += [(2 * pairs, " ".join(w)), (2 * pairs + 1, " ".join(v))]
            pairs += 1
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")))
    assert [got[i]["component_id"] for i in range(1, 2 * pairs, 2)] == list(range(0, 2 * pairs, 2))


def test_a_bucket_of_several_tiles(spark, monkeypatch):
    """Edited copies of one text, many of them unlinked, against a comparison of all pairs; tiles are small."""
    monkeypatch.setattr(near_dedup, "TILE", 16)
    pick = random.Random(22)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(260):
        w = list(base)
        for _ in range(pick.randint(0, 7)):
            w[pick.randrange(150)] = f"x{pick.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")))
    assert [got[i]["component_id"] for i in range(len(texts))] == label and len(set(label)) > 20


def test_rows_that_share_an_id_only(spark):
    docs = [(1, BASE), (1, PASSAGE), (1, ""), (2, BASE), (3, PASSAGE), (4, LONG), (4, LONG)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(got) == 7 and len({r["component_id"] for r in got if r["id"] == 1 and r["n_shingles"]}) == 1
    linked = {r["id"]: r["component_id"] for r in got if r["id"] > 1}
    assert sorted(linked.values()) in ([1, 3, 4], [1, 2, 4])


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_words_that_collide_in_polynomials(spark):
    """Two long words, and two runs of words, of which polynomials modulo 2**64 can't tell one from the other."""
    a, b = ("".join(x[i] for i in thue_morse(1024)) for x in ("ab", "ba"))
    around = prose(60)
    docs = spark.createDataFrame([(1, f"{around} {a}"), (2, f"{prose(60)} {b}"), (3, a), (4, b)], "doc_id bigint, text string")
    got = by_id(near_dedup.near_duplicates(docs))
    assert got[4]["component_id"] == 4 and got[3]["component_id"] == 3
    left = around.rsplit(" ", 49)[1:]
    docs = spark.createDataFrame([(1, " ".join([*left, a])), (2, " ".join([*left, b])), (3, " ".join([*left, a]))], "doc_id bigint, text string")
    got = by_id(substring_dedup.remove_repeats(docs))
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 0, 50]


def test_substrings(docs, nothing):
    first = {}
    words = [split(t) for t in TEXTS]
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = by_id(substring_dedup.remove_repeats(docs))
    for i, w in enumerate(words):
        gone = {q for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for q in range(k, k + 50)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(w), len(gone), kept)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert substring_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("fan", [substring_dedup.FAN, 5])
def test_substrings_shared_in_part_within_a_buffer(spark, monkeypatch, fan):
    """Dealt at once and in two steps. Each task has buffers of its own. A passage of 60 words stands on and off the block grid, whole and in part."""
    monkeypatch.setattr(substring_dedup, "FAN", fan)
    pick = random.Random(11)
    fresh = iter(range(10**9))
    off = lambda n: [f"f{next(fresh)}" for _ in range(n)]
    p = [[f"p{k}w{i}" for i in range(60)] for k in range(12)]
    tasks = [[(1, off(3) + p[0][20:] + off(9)), (2, p[0])], [(3, off(7) + p[0] + off(5))]]
    # the largest document of a buffer is all that a smaller one elsewhere meets
    tasks += [[(11, off(3) + p[1][20:] + off(9)), (13, off(4) + p[1])], [(12, p[1])]]
    random_docs = []
    for i in range(100, 200):
        w = off(pick.choice([0, 0, 25, pick.randint(1, 30)]))
        for _ in range(2):
            a = pick.choice([0, 0, pick.randint(0, 30)])
            w += pick.choice(p[2:])[a : a + pick.choice([60, 60, 40, 52])] + off(pick.randint(0, 30))
        random_docs.append((i, w))
    pick.shuffle(random_docs)
    tasks += [random_docs[k::12] for k in range(12)]
    dealt = spark.sparkContext.parallelize(tasks, len(tasks)).flatMap(lambda task: [(i, " ".join(w)) for i, w in task])
    frame = spark.createDataFrame(dealt, "doc_id bigint, text string")
    docs = dict(sum(tasks, []))
    first = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - 49):
            first.setdefault(tuple(docs[i][k : k + 50]), i)
    got = by_id(substring_dedup.remove_repeats(frame))
    for i, w in docs.items():
        gone = {q for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for q in range(k, k + 50)}
        assert (i, got[i]["n_removed"]) == (i, len(gone))


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, docs, nothing, block):
    items = [("9", PASSAGE[:200]), ("10", "one two"), ("a", None), (None, "one"), ("b", "!!")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(t))
    wins = {}
    for i, t in items:
        if i and t and (w := cut(t)):
            for k in range(len(w) - min(13, len(w)) + 1):
                wins.setdefault(tuple(w[k : k + 13]), set()).add(i)
    got = by_id(decontaminate.judged(decontaminate.scan(docs, bench, block_bytes=block)))
    for i, t in enumerate(TEXTS):
        w, hit, found = cut(t), set(), set()
        for g, who in wins.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= who
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(found))
        assert got[i]["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate.scan(nothing, bench).count() == 0
    cleaned = by_id(decontaminate.remove_spans(docs, decontaminate.scan(docs, bench)))
    assert cleaned[4]["text"] == "" and cleaned[3]["text"] == "one"
    assert decontaminate.remove_documents(docs, bench).columns == docs.columns


def test_decontamination_keeps_rows_apart(spark):
    bench = spark.createDataFrame([(str(i), f"item{i} " + PASSAGE[:150]) for i in range(4)] + [("x", "one two")], "item_id string, text string")
    texts = [(None, "one two"), (None, "three"), (None, None), (None, "one two"), (3, PASSAGE), (3, "clean words"), (3, "one two three four"), (4, PASSAGE)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    key = lambda r: (r["id"] or -1, r["n_words"], r["n_hit"], r["items"], r["contaminated"])
    one, many = (sorted(map(key, decontaminate.judged(decontaminate.scan(docs, bench, block_bytes=b)).collect())) for b in (1 << 20, 160))
    assert one == many and [x[:3] for x in one if x[0] == -1] == [(-1, 0, 0), (-1, 1, 0), (-1, 2, 2), (-1, 2, 2)] and len(many) == len(texts)


def test_stages_decide_by_row(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([("i", PASSAGE)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    other = prose(50)
    made = [(None, BASE), (1, BASE), (None, LONG), (5, PASSAGE), (5, other), (None, PASSAGE), (6, LONG), (6, LONG), (7, ""), (7, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in made], "doc_id bigint, text string, lang string, source string").repartition(3)
    left = lambda df: sorted((r["doc_id"] or -1, r["text"]) for r in df.collect())
    near = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    assert left(near) == sorted([(-1, ""), (1, BASE), (5, PASSAGE), (5, other), (6, LONG), (7, "")])
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert left(clean) == sorted((i or -1, t) for i, t in made if t != PASSAGE)
    many = spark.createDataFrame([(None, "a", "en", "s")] * 300 + [(i, "b", "de", "t") for i in range(30)], docs.schema)
    mixed = corpus_pipeline.mix_sources(spark, many, str(tmp_path)).groupBy("lang").count().collect()
    assert dict(mixed)["de"] == 30 and 0 < dict(mixed)["en"] < 300


PIECES = [" ", "  ", "\n", "a", "I'll", "'s", "é", "1", "٣", "😀", "\x1c", "<|endoftext|>", "<|startoftext|>", "日本", "Σ", ".", "...", "x.", "aaaa", "́", ""]


def test_tokens(spark, nothing):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    pick = random.Random(2)
    texts = [None, *TEXTS[1:], *("".join(pick.choice(PIECES) for _ in range(pick.randint(0, 25))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = by_id(token_counts.count_tokens(df, P.path("byte_bpe_50k.json")))
    assert [got[i]["n_tokens"] for i in range(len(texts))] == [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert token_counts.count_tokens(nothing, P.path("byte_bpe_50k.json")).count() == 0


def test_tokens_of_runs_without_spaces():
    """Encoded data and repetitions of many thousand letters, as the library has them, in time that follows their length."""
    P = pytest.importorskip("public_tokenizers")
    import time

    from tokenizers import Tokenizer

    pick = random.Random(71)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    texts = ["".join(pick.choice(letters) for _ in range(n)) for n in (2047, 2048, 5000, 30_000)]
    texts += ["ab" * 4000, "a" * 9001, "the" * 3000 + " end", "é" * 3000, "".join(pick.choice("ab") for _ in range(20_000))]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counter = token_counts.Merger(P.path("byte_bpe_50k.json"))
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    began = time.perf_counter()
    counter.count(["".join(pick.choice(letters) for _ in range(1_000_000))])
    assert time.perf_counter() - began < 30


def test_very_long_texts(spark):
    """Documents of 7 MB beside a short one: near duplicates, repeats, benchmark hits and tokens are found in it."""
    P = pytest.importorskip("public_tokenizers")
    base = " ".join(f"w{k % 9973}x{k % 7919}" for k in range(640_000))
    texts = [(1, base), (2, base + " tail"), (3, PASSAGE), (4, base[:4_000_000] + " " + PASSAGE)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert len(base) > 6_500_000
    got = by_id(near_dedup.near_duplicates(docs))
    assert [got[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 3, 4]
    cut = by_id(substring_dedup.remove_repeats(docs).select("id", "n_words", "n_removed"))
    assert [cut[i]["n_words"] - cut[i]["n_removed"] for i in (1, 2, 3)] == [640_000, 1, 80] and cut[4]["n_words"] - cut[4]["n_removed"] <= 1
    bench = spark.createDataFrame([("i", PASSAGE)], "item_id string, text string")
    hit = by_id(decontaminate.judged(decontaminate.scan(docs, bench)).select("id", "n_hit", "contaminated"))
    assert [(hit[i]["n_hit"] > 0, hit[i]["contaminated"]) for i in (1, 2, 3, 4)] == [(False, False), (False, False), (True, True), (True, False)]
    counted = by_id(token_counts.count_tokens(docs.where("doc_id in (1, 3)"), P.path("byte_bpe_50k.json")))
    assert counted[1]["n_bytes"] == len(base) and counted[1]["n_tokens"] > 640_000


def test_token_files(spark, nothing, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    pick = random.Random(3)
    texts = [*TEXTS, *("".join(pick.choice(PIECES) for _ in range(pick.randint(0, 25))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    path = f"file://{tmp_path}/orc"
    token_files.write_orc(df, path, P.path("word_bpe_49k.json"), part_bytes=20_000)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [[*e.ids, 1] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {r["doc_id"]: r for r in token_files.digest_orc(spark, path).collect()}
    start = 0
    for i, ids in enumerate(want):
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(raw))
        start += len(ids)
    assert [list(r["ids"]) for r in token_files.read_orc(spark, path, [6]).collect()] == [want[6]]
    token_files.write_orc(nothing, f"file://{tmp_path}/none", P.path("word_bpe_49k.json"))
    assert token_files.digest_orc(spark, f"file://{tmp_path}/none").count() == 0


def test_token_files_of_wild_ids(spark, tmp_path):
    """Random 64-bit ids, many rows of one id and many without: files stay small, starts follow their order, and no
    task gets all rows. Readers skip what statistics and Bloom filters rule out."""
    P = pytest.importorskip("public_tokenizers")
    pick = random.Random(31)
    made = [(pick.randrange(-(2**63), 2**63), prose(8)) for _ in range(400)] + [(None, "same")] * 300 + [(-5000, "a b")] * 300
    path = f"file://{tmp_path}/wild"
    token_files.write_orc(spark.createDataFrame(made, "doc_id bigint, text string").repartition(4), path, P.path("word_bpe_49k.json"), part_bytes=8000, stride=1000)
    digest = token_files.digest_orc(spark, path)
    assert "SinglePartition" not in digest._jdf.queryExecution().toString()
    got = sorted(digest.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in got] == [False] * 300 + [True] * 700
    assert [r["doc_id"] for r in got[300:]] == sorted(r["doc_id"] for r in got[300:])
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    rows = token_files.read_orc(spark, path)
    per_file = [r["count"] for r in rows.groupBy("_metadata.file_name").count().collect()]
    assert len(per_file) > 8 and max(per_file) < 300
    ordered = [r["doc_id"] for r in sorted(rows.select("doc_id", "place", "_metadata.file_name").collect(), key=lambda r: (r["file_name"], r["place"]))]
    assert ordered == [r["doc_id"] for r in got]
    one = token_files.read_orc(spark, path, [got[-1]["doc_id"]])
    assert one.count() == 1 and "PushedFilters: [" in one._jdf.queryExecution().toString() and "(doc_id" in one._jdf.queryExecution().toString()


def test_strides_are_skipped(spark, tmp_path):
    """One file of 40 strides: of a document, its stride is read alone."""
    P = pytest.importorskip("public_tokenizers")
    docs = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    path = f"file://{tmp_path}/strides"
    token_files.write_orc(docs, path, P.path("word_bpe_49k.json"), part_bytes=1 << 30, stride=1000)
    # rows that the scan hands on before the filter is applied to each
    conf = spark.conf.get("spark.sql.orc.filterPushdown")
    try:
        read = []
        for pushed in ("true", "false"):
            spark.conf.set("spark.sql.orc.filterPushdown", pushed)
            df = token_files.read_orc(spark, path, [20_500])
            assert df.count() == 1
            plan = df._jdf.queryExecution().executedPlan()
            df.collect()
            rows = scan_rows(plan)
            read.append(rows)
    finally:
        spark.conf.set("spark.sql.orc.filterPushdown", conf)
    assert read[0] <= 2000 < 40_000 == read[1]


def scan_rows(plan):
    """Rows that a plan's scan has read."""
    if plan.getClass().getSimpleName() == "FileSourceScanExec":
        return plan.metrics().apply("numOutputRows").value()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return scan_rows(plan.executedPlan())
    children = plan.children()
    return sum(scan_rows(children.apply(i)) for i in range(children.size()))


def test_shards(docs, nothing):
    got = by_id(sharding.assign_shards(docs, shards=5))
    load = [0] * 5
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        load[got[i]["shard"]] += got[i]["size"]
    together = {}
    for i, t in enumerate(TEXTS):
        together.setdefault(t or "", set()).add(got[i]["shard"])
    assert all(len(s) == 1 for s in together.values())
    for s in range(5):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values())))
    # each group is a unit of its own here, so this is the plain schedule by groups
    sizes = {}
    for i, t in enumerate(TEXTS):
        sizes.setdefault(t or "", []).append(got[i]["size"])
    plain = [0] * 5
    for size in sorted((sum(x) for x in sizes.values()), reverse=True):
        plain[plain.index(min(plain))] += size
    assert max(load) <= max(plain) * 1.1
    assert sharding.assign_shards(nothing).count() == 0


def test_mixing(docs, nothing):
    got = mixing.mix(docs)
    share = {r["source"]: r["w"] for r in got.groupBy("source").agg(F.sum(F.col("tokens") * F.col("ratio")).alias("w")).collect()}
    own = {r["source"]: r["w"] for r in got.groupBy("source").agg(F.sum("tokens").alias("w")).collect()}
    want = {s: w**mixing.TEMPER for s, w in own.items()}
    for s in own:
        assert share[s] / sum(share.values()) == pytest.approx(want[s] / sum(want.values()), rel=0.05)
    r = got.collect()
    assert len(r) == len(TEXTS) and all(x["kept"] for x in r if x["probability"] >= 1)
    assert all(x["ratio"] == pytest.approx(x["probability"] * x["weight"]) for x in r)
    assert mixing.mix(nothing).count() == 0


def test_mixing_plans_stay_small(docs, monkeypatch):
    """A step's plan doesn't hold the steps before it twice over: the driver plans it anew for each of its stages."""
    joins, save = {}, mixing.Scratch.save

    def counted(self, df, name):
        joins[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return save(self, df, name)

    monkeypatch.setattr(mixing.Scratch, "save", counted)
    mixing.mix(docs)
    assert sum(name.startswith("fit-") for name in joins) >= mixing.CYCLES
    assert max(joins.values()) <= 3, joins


def test_mixing_error(spark):
    cells = spark.createDataFrame([("a", "x", "t", 6.0), ("b", "x", "t", 3.0), ("c", "x", "t", 1.0)], "source string, lang string, topic string, fitted double")
    frames = lambda source: {d: spark.createDataFrame(rows, f"{d} string, target double") for d, rows in (("source", source), ("lang", [("x", 2.0)]), ("topic", [("t", 5.0)]))}
    off = lambda *source: mixing.marginal_error(cells, frames(list(source)))
    assert off(("a", 12.0), ("b", 6.0), ("c", 2.0)) == pytest.approx(0, abs=1e-12)
    assert off(("a", 0.4), ("b", 0.5), ("c", 0.1)) == pytest.approx(0.5)  # a has 0.6 of 0.4
    assert off(("a", 0.6), ("b", 0.3), ("c", 0.05), ("d", 0.05)) == pytest.approx(1)  # c has twice its share, d nothing
    assert off(("a", 0.65), ("b", 0.35), ("c", None)) == pytest.approx(1 - 0.3 / 0.35)  # c's 0.1 is less


def test_mixing_meets_sparse_targets_or_tells(spark, recwarn):
    cells = [("a", "x", 900), ("a", "y", 200), ("b", "y", 500), ("b", "z", 200), ("c", "z", 700), ("c", "x", 600)]
    docs = spark.createDataFrame([(i, "w" * 4 * n, s, c) for i, (s, c, n) in enumerate(cells)], "doc_id bigint, text string, source string, lang string")
    share = lambda got, d: {r[d]: r["w"] for r in got.groupBy(d).agg(F.sum(F.col("tokens") * F.col("ratio")).alias("w")).collect()}
    aims = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.45, "y": 0.3, "z": 0.25}}
    frames = lambda aims: {d: spark.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in aims.items()}
    got = mixing.mix(docs, targets=frames(aims))
    for d, want in aims.items():
        now = share(got, d)
        assert {k: w / sum(now.values()) for k, w in now.items()} == pytest.approx(want, rel=1e-5)
    assert not [w for w in recwarn if "mixture" in str(w.message)]
    lone = docs.where("source = 'a' or lang = 'z' and source = 'c'")
    with pytest.warns(UserWarning, match="aren't met"):
        mixing.mix(lone, targets=frames({"source": {"a": 0.5, "c": 0.5}, "lang": {"x": 0.2, "y": 0.2, "z": 0.6}}))


PAGE = """<html><head><title>t</title></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=a>A</a></ul></nav><div id="main{n}"><div class="post-{n} body"><h1>Head &amp; line</h1>
<p>First  paragraph, <b>long</b> enough to count as text.<p>Second&nbsp;one<br>after a break.<div class="advert">Buy</div><ul><li>one<li>two</ul><div class="comments"><p>Reader says a lot of things here.</p></div></div></div>
<div class="cookie-notice"><p>We use cookies.</p></div><footer><p>(c)</p></footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_html(spark, docs):
    pages = [(i, "http://h.example/a" if i else None, PAGE.replace("{n}", str(i))) for i in range(3)] + [(7, "http://h.example/b", None), (8, "::bad", "plain <b>text"), (9, "http://[", "<p>" * 3000)]
    got = by_id(html_text.extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")))
    want = "Head & line\n\nFirst paragraph, long enough to count as text.\n\nSecond one after a break.\n\none\n\ntwo"
    assert [got[i]["text"] for i in range(3)] == [want] * 3 and got[0]["n_chars"] == len(want)
    assert got[7]["text"] == "" and got[8]["text"] == "plain text" and got[9]["text"] == ""
    assert html_text.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_html_keeps_linked_headings_and_paragraphs():
    body = "<p>A paragraph that is long enough to be the main text of this page.</p>" * 3
    linked = "<h1><a href=/t>Title &amp; more</a></h1>{}<p><a href=/s>A linked paragraph</a></p><div>Source: <a href=/l>a rather long linked name</a></div>"
    menus = "<ul><li><a href=/a>One</a><li><p><a href=/b>Two</a></p></ul><div><a href=/c>Three</a> | <a href=/d>Four</a></div>"
    got = html_text.extract(f"<body><article>{linked.format(body)}{menus}</article></body>", []).split("\n\n")
    assert got == ["Title & more", *["A paragraph that is long enough to be the main text of this page."] * 3, "A linked paragraph", "Source: a rather long linked name", "One", "Two"]
    # a list of links that only the page holds is a menu
    assert "One" not in html_text.extract(f"<body>{body}{menus}</body>", [])


LINE = "This is a sentence of the article that is long enough to count. "


@pytest.mark.parametrize("name", ["class=form-factor", "class='share-price'", "id=hidden-gems", "class='commentary'", "class=promotion-of-trade"])
def test_html_keeps_names_that_only_hold_a_word_of_boilerplate(name):
    page = f"<body><article><p>{LINE * 5}</p><div {name}><p>{LINE}</p></div><div class='share-buttons'><p>Share</p></div><div id=comment-list><p>Ha</p></div></article></body>"
    assert html_text.extract(page, []) == f"{(LINE * 5).strip()}\n\n{LINE.strip()}"


def test_html_keeps_linked_quotations_and_siblings(spark):
    quote = f"<article><p>{LINE * 4}</p><blockquote><a href=x>A linked quotation</a></blockquote><blockquote><div><a href=x>Another</a></div></blockquote><ul><li><a href=y>A linked item</a></ul></article>"
    assert html_text.extract(quote, []).split("\n\n")[1:] == ["A linked quotation", "Another", "A linked item"]
    page = f"<body><div class=lead><p>{LINE * 3}</p></div><div class=rest><p>{LINE * 6}</p></div><div class=more><ul><li><a href=a>Elsewhere</a></ul></div></body>"
    urls = ["http://u@Host.example:80/a", " HTTP://host.example/b?x", "//host.example#c", "http://[::1]/a", "none/at/all", None]
    rows = [(i, u, page) for i, u in enumerate(urls)]
    got = by_id(html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")))
    assert {r["text"] for r in got.values()} == {f"{(LINE * 3).strip()}\n\n{(LINE * 6).strip()}"}
    hosts = [r["h"] for r in spark.createDataFrame(rows, "page_id bigint, url string, html string").select(html_text.host_of(F.col("url")).alias("h")).collect()]
    assert hosts == ["host.example"] * 3 + ["[::1]", "", ""]


def test_html_against_a_plain_extractor(spark):
    """Generated pages: what stands in the article, cut at block tags, without any container logic."""
    pick = random.Random(41)
    pages, want = [], []
    for i in range(40):
        paragraphs = [prose(pick.randint(5, 60)) for _ in range(pick.randint(2, 9))]
        around = "<nav><ul><li><a href=a>x y</a></ul></nav>", f"<div class=ad>{prose(4)}</div>", f"<footer>{prose(5)}</footer>", f"<div class='comments'><p>{prose(30)}</p></div>"
        article = "".join(f"<p>{p}</p>\n" for p in paragraphs)
        pages.append((i, f"http://h{i % 3}.example/{i}", f"<html><body>{around[0]}{around[1]}<article><h1>T {i}</h1>{article}</article>{around[3]}{around[2]}</body></html>"))
        want.append("\n\n".join([f"T {i}", *paragraphs]))
    got = by_id(html_text.extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)))
    assert [got[i]["text"] for i in range(40)] == want


def test_distances_are_plain_compressions():
    """Without memory of words or precomputed dictionaries."""
    import zstandard

    pick = random.Random(51)
    ordinary = [prose(40) for _ in range(80)]
    toxic = [t + " " + " ".join(pick.sample(["grubnak", "vilescum", "trashling"], 2)) for t in ordinary[:40]]
    model = toxicity.fit(toxic, ordinary[40:], 0.5)
    params = dict(window_log=16, hash_log=15, chain_log=15, search_log=5, min_match=4, target_length=0, strategy=zstandard.STRATEGY_GREEDY)
    params = zstandard.ZstdCompressionParameters(**params, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)

    def size(content, window):
        known = zstandard.ZstdCompressionDict(content + toxicity.TRAILER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress(window + toxicity.TRAILER))

    for text in (toxic[0], ordinary[60], "One grubnak", ""):
        words = text.lower().split()
        one = [f" {w} ".encode() for w in words]
        ten = [f" {' '.join(words[k : k + 10])} ".encode() for k in range(0, len(words), 10)]
        assert model.word_distances(text).tolist() == [size(model.base, w) - size(model.base + model.own, w) for w in one]
        assert model.distances(text).tolist() == [size(model.base, w) - size(model.base + model.phrases, w) for w in ten]


def test_training_takes_one_bounded_text_of_an_id(spark):
    docs = spark.createDataFrame([(i, "a b c " * 40_000) for i in range(12)] + [(1, "zz"), (None, "n")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, toxic int")
    seen = []
    fit, toxicity.fit = toxicity.fit, lambda toxic, ordinary, prior: seen.extend((toxic, ordinary))
    try:
        toxicity.train(docs, labels)
    finally:
        toxicity.fit = fit
    kept = [i for i in range(12) if zlib.crc32(str(i).encode()) % 5]
    assert [len(x) for x in seen] == [sum(i % 2 for i in kept), sum(1 - i % 2 for i in kept)]
    assert all(len(t) <= toxicity.SAMPLED_CHARS + toxicity.EXCERPTS for x in seen for t in x)


def test_toxicity(spark, nothing):
    bad = ["grubnak", "vilescum", "trashling", "mudface", "snotrag"]
    pick = random.Random(9)

    def text(toxic):
        w = [pick.choice(VOCABULARY) for _ in range(pick.randint(20, 150))]
        for k in range(0, len(w), 25) if toxic else ():
            w[min(k + pick.randint(0, 20), len(w) - 1)] = pick.choice(bad)
        return " ".join(w)

    made = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made] + [(None, 1), (5000, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    scored = by_id(toxicity.score(docs, model))
    held = [(scored[i]["score"] >= 0.5, y) for i, _, y in made if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score(empty, model).collect())
    assert toxicity.score(nothing, model).count() == 0 and toxicity.drop_toxic(nothing, model).columns == nothing.columns


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, decided by plain Python."""
    import corpus_pipeline

    pick = random.Random(61)
    bad = ["grubnak", "vilescum", "trashling", "mudface", "snotrag"]
    docs, labels = [], []
    for i in range(400):
        w = prose(pick.randint(20, 60)).split()
        if i % 8 == 0:
            for k in range(0, len(w), 10):
                w[k] = pick.choice(bad)
        docs.append((i, " ".join(w), pick.choice(["en", "de", None]), pick.choice(["a", "a", "a", "b", None]), len(w)))
        labels.append((i, 0, int(i % 8 == 0)))
    for i in range(400, 430):
        text = docs[i - 395][1]
        docs.append((i, text if i % 2 else text + " more", "en", "b", 0))
    docs += [(430, None, "en", "a", 0), (431, "", None, "b", 0), (432, docs[3][1] + " " + PASSAGE[:150], "en", "a", 0)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, columns).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", PASSAGE[:150])], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rows = {d[0]: d for d in docs}
    model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [i for i in rows if model.scores([rows[i][1]])[0] < 0.5]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := split(fold(rows[i][1]))) else set() for i in left}
    label = {i: i for i in left}
    for i in left:
        for j in left:
            if j < i and label[i] != label[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    left = [i for i in left if label[i] == i]
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(t))
    item = cut(PASSAGE[:150])
    windows = {tuple(item[k : k + 13]) for k in range(max(1, len(item) - 12))}

    def hit(w):
        return {q for k in range(len(w)) for q in range(k, k + min(13, len(item))) if tuple(w[k : k + min(13, len(item))]) in windows}

    left = [i for i in left if not (h := hit(w := cut(rows[i][1]))) or 20 * len(h) < len(w)]
    # raking, as in the operator: tempered shares of source, language and topic
    cell = {}
    for i in left:
        t = rows[i][1] or ""
        topic = next((n for n, cue in mixing.CUES if re.search(cue, t)), mixing.OTHER)
        cell[i] = (rows[i][3] or "unknown", rows[i][2] or "unknown", topic, max(1, -(-len(t.encode()) // 4)))
    own = {}
    for *c, n in cell.values():
        own[tuple(c)] = own.get(tuple(c), 0) + n
    fitted = dict(own)
    side = lambda of, d: {v: sum(x for c, x in of.items() if c[d] == v) for v in {c[d] for c in of}}
    goal = [{v: w**mixing.TEMPER for v, w in side(own, d).items()} for d in range(3)]
    for _ in range(400):
        for d in range(3):
            now = side(fitted, d)
            fitted = {c: x * goal[d][c[d]] / sum(goal[d].values()) / now[c[d]] for c, x in fitted.items()}
    ratio = {c: fitted[c] / sum(fitted.values()) / (own[c] / sum(own.values())) for c in own}
    chance = lambda i: int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:8], 16) / 2**32
    left = [i for i in left if ratio[cell[i][:3]] >= 1 - 1e-9 or chance(i) < ratio[cell[i][:3]]]
    assert sorted(got) == sorted(left) and 100 < len(left) < len(rows) - 60
    for i in left:
        raw = (rows[i][1] or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    for s in range(40):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values())))
    load = [sum(r["size"] for r in got.values() if r["shard"] == s) for s in range(40)]
    assert max(load) - min(load) <= max(r["size"] for r in got.values())
