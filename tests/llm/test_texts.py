"""Encoding against the tokenizer library, mixing against its definition, reading levels on planted texts."""

import random
from pathlib import Path

import pytest

from strandloom.llm import bpe, encoding, mixing, reading

FOLDER = Path(encoding.VOCABULARIES)
TEXTS = [
    "", " ", "It's 's ''s I'll'll we've\n\n  x", "  a  ", "'", "x'", " 'tis  the\tend \r\n", "naïve 日本語 🙂🙂 ²³ x", "x" * 5000, "ab'" * 300, "<|endoftext|>", "!'s x's 1's's", "a\x00b", " 　z", "l'été d'où 'll",
]


@pytest.fixture(scope="module")
def merger():
    return bpe.Merger(bpe.read_ranks((FOLDER / "byte_bpe_50k.tiktoken").read_bytes()))


def test_ids_equal_the_library(merger):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(FOLDER / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice("ab1 '\n\tsé!日 ") for _ in range(r.randrange(60))) for _ in range(400)]
    ids, counts, offsets = bpe.encode(texts, merger)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == t.encode(text, add_special_tokens=False).ids, text
        assert all(0 <= o < len(text) for o in offsets[at : at + n])
        at += n


def test_long_merge_equals_short(merger):
    r = random.Random(2)
    for _ in range(50):
        data = bytes(r.choice(b"abcde ,") for _ in range(r.randrange(1, 120)))
        assert merger._merge_long(data) == merger._merge_short(data)


def test_scan_over_many_blocks(merger):
    text = " ".join("it's %d\n\n" % i for i in range(3000))
    found, starts, counts = bpe.pieces([text, "", text])
    assert "".join(found) == text + text and counts[1] == 0 and counts[0] == counts[2]
    assert [text[s : s + len(p)] for s, p in zip(starts[: counts[0]], found, strict=False)] == found[: counts[0]]


def test_encoded_documents(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "doc_id bigint, text string, ids string")
    rows = {r["doc_id"]: r for r in encoding.encoded(df, offsets=True).collect()}
    assert rows[0]["ids"] == [] and rows[len(TEXTS)]["ids"] == [] and len(rows[2]["ids"]) == len(rows[2]["offsets"])
    back = {r["doc_id"]: r["text"] for r in encoding.decoded(encoding.encoded(df)).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS))
    assert encoding.encoded(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        encoding.encoded(df, name="word_bpe_49k")


def test_offsets_bound_the_pieces(merger):
    """The ids from one offset to the next are those of the slice of text between: a decoder can start at any of them."""
    text = "It's 12 o'clock -- l'été d'où 日本語 🙂🙂\n\n  end "
    ids, _, offsets = bpe.encode([text], merger)
    starts = sorted(set(offsets.tolist()))
    for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
        assert merger[text[a:b]] == tuple(ids[offsets == a].tolist())


def test_water_fill():
    assert mixing.water_fill(100, [(1, 1000), (1, 1000)]) == [50, 50]
    assert mixing.water_fill(100, [(1, 10), (1, 1000), (2, 1000)]) == [10, 30, 60]
    assert mixing.water_fill(100, [(1, 10), (1, 20), (0, 99)]) == [10, 20, 0]
    assert mixing.water_fill(100, []) == [] and mixing.exact_total([(1, 10), (3, 60)]) == 40


def test_plan():
    rows = mixing.plan([("big", 0.5, 1, 900), ("none", 0.2, 9, 0), ("off", None, 3, 50), ("small", 0.5, 4, 100)])
    assert [(r[0], r[2], r[3], r[4]) for r in rows] == [("big", 0.5, 400.0, 0), ("none", 0.0, 0.0, 0), ("off", 0.0, 0.0, 0), ("small", 0.5, 400.0, 4)]
    assert [r[3] for r in mixing.plan([("big", 0.5, 1, 900), ("small", 0.5, 4, 100)], "pass")] == [600.0, 400.0]


def test_mix(spark):
    docs = [(i, "big" if i % 10 else "small", "word " * (5 + i % 7)) for i in range(600)] + [(1000, None, "x"), (1001, "big", None), (1002, "big", "")]
    docs += [(2000 + i, "small", "") for i in range(600)]  # texts without tokens are no way around the cap
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.5, 4), ("m", "none", 0.2, 9), ("n", "big", 0.0, 1), (None, "big", 1.0, 1)], "mix_name string, source string, weight double, max_repeats int")
    chosen, shares = mixing.mix(df, targets)
    s = {r["source"]: r for r in shares.where("mix_name = 'm'").collect()}
    assert abs(s["big"]["actual_share"] - 0.5) < 0.01 and s["small"]["passes"] == 4 and s["none"]["used_tokens"] == 0 and s["none"]["missing"]
    assert s["big"]["reachable_share"] == 0.5 and s["none"]["reachable_share"] == 0
    assert chosen.where("source = 'small' and copies > 4 or source = 'big' and copies > 1 or mix_name = 'n'").count() == 0
    again, _ = mixing.mix(df, targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))
    picked, full = mixing.mix(df, targets, total="pass")
    assert {r["source"]: r["clamped"] for r in full.where("mix_name = 'm'").collect()} == {"big": False, "small": True, "none": False}
    for got in (mixing.checked(chosen, shares, targets), mixing.checked(picked, full, targets)):
        assert got.where("over_cap > 0 or not share_met").count() == 0
    half, at_half = mixing.mix(df, targets, total=500.0)  # a small source with a fraction: the document at the cut goes to the nearer side
    assert mixing.checked(half, at_half, targets).where("over_cap > 0 or not share_met").count() == 0
    assert mixing.mix(df.limit(0), targets)[0].count() == 0 and mixing.mix(df, targets.limit(0))[0].count() == 0


def test_reading_levels(spark):
    easy, hard = "The cat sat on the mat with the dog. The boy ran to the pond and the hill. ", "The epistemological quorum adjudicates the heterogeneous moiety of the jurisprudential lemma in the stochastic nexus. "
    docs = [(i, "Home | Shop | Login\n" + (hard if i % 2 else easy) * (2 + i % 3) + "\nAll rights reserved.") for i in range(60)]
    docs += [(100, None), (101, "  \n "), (102, "これは本です。"), (103, "Menu\nShop"), (104, easy * 3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 5 if i % 2 else 1) for i in range(40)] + [(102, 0), (7, 9), (None, 1)], "doc_id bigint, reading_level int")
    got = {r["doc_id"]: r["level"] for r in reading.levels(df, reading.fit(df, labels)).collect()}
    assert all(got[i] == (5 if i % 2 else 1) for i in range(60))
    assert (got[100], got[101], got[102], got[103], got[104]) == (None, None, 0, 0, 1)
    assert sorted(r[0] for r in reading.demanding(df, labels).collect()) == list(range(1, 60, 2))
    assert reading.demanding(df.limit(0), labels.limit(0)).count() == 0


def test_languages_are_found_whatever_the_documents_say(spark):
    """A fifth of the labelled documents say nothing or the wrong language; each still ends under that of its words."""
    r = random.Random(3)
    words = {"en": ["the boy", "ran", "to the", "pond", "and", "hill", "with", "a dog"], "es": ["la casa", "hace", "el pan", "y la", "leña", "con", "mamá", "una mesa"]}
    hard = {"en": "quorum adjudicates", "es": "quorum dirime"}
    docs, labels = [], []
    for i in range(200):
        lang = ("en", "es")[i % 2]
        text = " ".join(r.choice(words[lang]) for _ in range(12)) + (f" {hard[lang]} moiety" if i % 4 > 1 else "")
        docs.append((i, text + ".", None if i % 10 == 3 else ("es", "en")[i % 2] if i % 10 == 4 else lang))
        labels.append((i, 5 if i % 4 > 1 else 1))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    models = reading.fit(df, spark.createDataFrame(labels[:160], "doc_id bigint, reading_level int"))
    got = {x["doc_id"]: (x["lang"], x["level"]) for x in reading.levels(df, models).collect()}
    assert models.languages == ["en", "es"] and all(got[i] == (("en", "es")[i % 2], labels[i][1]) for i in range(200))


def test_quotes_and_unseen_tokens():
    assert reading.sentences('The boy ran home. “The quorum adjudicates the moiety of the nexus”. The dog sat on a mat.') == [["the", "boy", "ran", "home"], ["the", "dog", "sat", "on", "a", "mat"]]
    models = reading.Models.of_counts(["en"], reading.np.array([7, 8]), reading.np.array([1, 5]), reading.np.array([9.0, 9.0]), reading.np.array([0.0, 3, 0, 0, 0, 3]))
    some = models.scores(reading.np.array([99]), reading.np.array([1.0]))
    assert some[1] == pytest.approx(models.prior[1] + reading.np.log(0.1 / 9.2), abs=1e-5) and models.level(reading.np.array([8]), reading.np.array([2.0]))[1] == 5
