"""Clashing column names, odd markup, special tokens and odd rows through the whole pipeline."""

import json
import random
import time
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import exact_dedup, html_tree, mixing, overlap, packed_ids, pipeline, quality, simhash

NAMES = "__n __id __sha __none __score __gone __label __row row own sha n none id doc_id2 score component_id keep_id key t f bits node low cut extra text_sha256".split()
NEUTRAL = quality.fit([], [], np.array([]))
FILTERS = {
    "exact": exact_dedup.drop_duplicates,
    "near": simhash.drop_near_duplicates,
    "similar": overlap.drop_similar,
    "quality": lambda d: quality.keep_good(d, NEUTRAL),
    "mix": mixing.mix,
}


@pytest.mark.parametrize("name", FILTERS)
def test_no_column_of_the_caller_is_touched(spark, name):
    docs = spark.createDataFrame([(i, f"text {i} of several words here {i}", "en", "a", 20) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in NAMES:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")))
    rows = {tuple(r) for r in docs.collect()}
    kept = FILTERS[name](docs)
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and got and set(got) <= rows


def test_training_on_odd_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["Good text here.\nAnd more.", None, "", "$$ %% ^^\n$$ %%", "x\n" * 3000] * 3)] + [(None, "a"), (0, "Good text here.")], "doc_id long, text string")
    docs = docs.withColumn("__id", F.lit(1)).withColumn("__label", F.lit(1)).withColumn("own", F.lit(1)).withColumn("label", F.lit(1))
    schema = "doc_id long, quality int"
    both = [(i, int(i % 5 == 0)) for i in range(15)]
    for labels in ([], [(0, 1)], both, both * 2, [(None, 1), (3, None), (0, 0), (0, 1)]):
        field = quality.train(docs, spark.createDataFrame(labels, schema))
        scores = [r["score"] for r in quality.classify(docs, field).collect()]
        assert len(scores) == 17 and all(0 <= s <= 1 for s in scores)
    assert quality.train(docs.limit(0), spark.createDataFrame(both, schema)).scale == 0


def test_special_tokens_are_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    model, used, r = Tokenizer.from_file(path), packed_ids.WordTokenizer(path), random.Random(4)
    bits = ["<|EndOfText|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|", "|>", "EndOfText", " ", "\n", "Word", "é", "Ω", "don't", "x1", "İ", "<|endof", "text|>"]
    texts = ["a <|EndOfText|> b", "<|STARTOFTEXT|>"] + ["".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    ids, sizes = used.encode(texts)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_marks_are_cut_off_words_and_ids_are_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    model, used, r = Tokenizer.from_file(path), packed_ids.WordTokenizer(path), random.Random(5)
    used.encode(["Zwölfte zwölfte, zwölfte. zwölfte!?", "zwölfte; zwölfte:"])
    assert set(used.table) == {"zwölfte", ",", ".", "!?", ";", ":"}  # one entry, whatever marks follow
    bits = [*".,;:!?%&*$#|'", "'s", "'ll", "s", "T", "re", "word", "É", "ä", "ß", "İ", "ı", "ɏ", "ɐ", "×", "Σ", "ж", "字", "e\u0301", "\u0338", "\u0308", "7", "x1", "=", "<", "|>", "_", "-", " ", "\n", "\x1c", "\u00a0", "\u200b", "😀", "\x00"]
    texts = ["T\u0308 t\u0308", "H\u0331a", "J\u030c", "W\u030a", "Y\u030a", "T\u0334\u0308", "T\u0323\u0308"]  # small ones compose, capitals don't
    texts += ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(6000)]
    ids, sizes = used.encode(texts)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_marks_stay_where_they_are_no_pretokens(tmp_path):
    path = tmp_path / "other.json"
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "\\S+"}
    path.write_text(json.dumps(spec), encoding="utf-8")
    texts = ["One, two. Three!? x1. end", "t|> a.b. <|endoftext|> it's,"]
    ids, sizes = packed_ids.WordTokenizer(str(path)).encode(texts)
    assert ids.tolist() == [i for t in texts for i in Tokenizer.from_file(str(path)).encode(t, add_special_tokens=False).ids]


class _Text(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out = []
        self.feed(page)
        self.close()

    def handle_data(self, data):
        self.out.append(data)


def test_tags_are_read_as_a_parser_reads_them():
    r = random.Random(6)
    names = ["p", "div", "b", "i", "span", "li", "ul", "td", "a", "section", "h2", "em"]
    attributes = ["", " don't", ' x="a > b"', " y='<p>'", " hidden2", " z=un'quoted", ' w = "1"', " v=1/2", ' u="it\'s"', "/", ' "']
    pieces = ["text", " more ", "a &lt; b", "&amp;", "1 < 2", "5 > 4", "<!-- c -- d > -->", "it's", '"q"']
    for _ in range(3000):
        parts = [lambda: r.choice(pieces), lambda: f"<{r.choice(names)}{r.choice(attributes)}>", lambda: f"</{r.choice(names)}>"]
        page = "".join(r.choice(parts)() for _ in range(r.randint(1, 14)))
        got = "".join(t for _, t in sorted(b for n in html_tree.parse(page) for b in n.blocks))
        if page.count('"') % 2 == 0 or ' "' not in page:  # a stray quote is a name's part in both
            assert "".join(got.split()) == "".join("".join(_Text(page).out).split()), page


def test_no_text_is_lost_to_quotes():
    blocks = lambda page: [t for n in html_tree.parse(page) for _, t in n.blocks]
    assert blocks("<h1>Head</h1><p don't>One two three.</p><p>Four five.</p>") == ["Head", "One two three.", "Four five."]
    assert blocks('<p class="x>One two</p><p>Three</p>') == ["One two", "Three"]


@pytest.mark.parametrize("page", ["<a " * 350_000 + "'", "<b>" * 330_000, "<b>" * 160_000 + "</i>" * 120_000, "<i><div>" + "<b>" * 160_000 + "</i>" * 120_000, "<p class='x" * 90_000, '<a x="\'' * 120_000, "&" * 1_000_000, "<" * 1_000_000])
def test_any_markup_takes_time_in_proportion(page):
    began = time.time()
    html_tree.parse(page)
    assert time.time() - began < 4  # a fraction of a second on an idle core


def test_pipeline_on_odd_rows_and_an_empty_table(spark, tmp_path):
    long = "word and more words of a long text. " * 6000
    rows = [(1, "same text here", "en", "a", 14), (1, "same text here", "en", "a", 14), (2, "same  text here ", "en", "b", 16), (3, "", "en", None, 0), (4, None, None, "a", None), (None, "no id at all", "de", "a", 12), (5, long, "en", "c", len(long)), (6, long + "x", "en", "c", len(long) + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit("x"))
    spark.createDataFrame([(5, 1), (None, 0), (77, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for some, least in ((docs, 4), (docs.limit(0), 0)):
        kept = some
        for k, (_, stage) in enumerate(pipeline.STAGES):
            kept = stage(spark, kept, str(tmp_path))
            assert k == len(pipeline.STAGES) - 1 or kept.columns == list(pipeline.COLUMNS)
            if k == 2:
                assert {r["doc_id"] for r in kept.collect()} == ({2, 3, 5, None} if least else set())
        assert kept.count() >= least
