import math
import re
from collections import Counter

import numpy as np
import pytest

from conftest import SF001
from lendflow.llm import fertility, packing
from lendflow.llm.queries import op13_fertility

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    marked = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))


def brute_figures(text):
    """Characters per token, fallback and entropy straight from the two tokenizers."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    ids = Tokenizer.from_file(packing.vocabulary_path(packing.TOKENIZER)).encode(text, add_special_tokens=False).ids
    model = SentencePieceProcessor(model_file=packing.vocabulary_path(fertility.PIECES))
    pieces = model.encode(text, out_type=str)
    byte = [p for p in pieces if re.fullmatch(r"<0x..>", p) and p not in ("<0x09>", "<0x0A>", "<0x0B>", "<0x0C>", "<0x0D>")]
    n = len(ids)
    h = -sum(k / n * math.log2(k / n) for k in Counter(ids).values())
    return (n, 1000 * len(text) // n, 1000 * len(byte) // len(pieces),
            math.floor(1000 * (h / math.log2(n) if n > 1 else 1) + 0.5))


SPECIAL = ["a b c a b c", "a b c a b", "a a a a", "# x\n# x\n\n\n # x\n#  x\n", "x|y<z> $5 100%", "é ß ü 日本語 \U0001F600",
           "one two three\r\none two three\r\nfour", "\n\n \n", "\x0b\x0cword\x1cword", "a b c\n" * 40]


def test_base_counts_equal_brute_force(spark, corpus):
    rows = corpus + [(1000 + i, t, None, None) for i, t in enumerate(SPECIAL)]
    got = fertility.quality(frame(spark, rows).repartition(3)).collect()
    want = Counter((r[0], *brute_base(r[1])) for r in rows)
    assert Counter((r.doc_id, *(r[c] for c in BASE)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.reasons)


def test_figures_equal_the_tokenizers(spark, corpus):
    texts = [t for _, t, *_ in corpus if t] + SPECIAL
    got = fertility.measure(frame(spark, [(i, t, "en", None) for i, t in enumerate(texts)])).collect()
    for r in got:
        n, chars, fallback, entropy = brute_figures(texts[r.doc_id])
        assert (r.n_tokens, r.chars_per_token, r.fallback) == (n, chars, fallback)
        assert abs(r.entropy - entropy) <= 1


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in op13_fertility(spark, SF001).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert set(got) == set(docs)
    for i, d in docs.items():
        assert tuple(got[i][c] for c in BASE) == brute_base(d.text)

    def quartiles(values):
        v = sorted(values)
        return [v[math.ceil(len(v) * k / 4) - 1] for k in (1, 2, 3)]
    passed = [r for r in got.values() if not r.base_failed]
    for r in passed:
        reasons = []
        for c, least in fertility.FIGURES.items():
            own, wide = (quartiles(x[c] for x in passed if x.script == r.script and x.lang in langs)
                         for langs in ((r.lang,), {x.lang for x in passed}))
            n = sum(x.lang == r.lang and x.script == r.script for x in passed)
            centre = (own[1] * n + wide[1] * 32) / (n + 32)
            width = max(((own[2] - own[0]) * n + (wide[2] - wide[0]) * 32) / (n + 32), least)
            room = 3 * math.sqrt(1 + 500 / r.n_tokens) * width
            if c != "fallback" and r[c] < centre - room:
                reasons.append(f"{c}:low")
            if r[c] > centre + room:
                reasons.append(f"{c}:high")
        assert r.reasons == reasons and r.kept == (not reasons)


def test_clean_texts_stay_and_damaged_ones_go(spark):
    """Labelled documents: no one of good quality that passes the base rules goes; smashed keys and mixed encodings do."""
    found = fertility.quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = found.join(labels, "doc_id").where("quality = 1 AND NOT base_failed")
    assert good.count() > 100 and good.where("NOT kept").count() == 0
    rnd = np.random.default_rng(1)
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'fr'").limit(100).collect()]
    smashed = " ".join("".join(chr(97 + x) for x in rnd.integers(0, 26, rnd.integers(3, 9))) for _ in range(400))
    private = " ".join(chr(0xE000 + x) for x in rnd.integers(0, 500, 400))
    twice = (max(base, key=len)).encode().decode("latin-1")
    rows = [(i, t, "fr", None) for i, t in enumerate(base)] + [(901, smashed, "fr", None), (902, twice, "fr", None)]
    rows += [(950 + i, t, "fr", None) for i, t in enumerate([private])]
    got = {r.doc_id: r for r in fertility.quality(frame(spark, rows)).collect()}
    assert not got[901].kept and "chars_per_token:low" in got[901].reasons
    assert not got[902].kept
    assert got[950].script == "other"


def test_script_of():
    assert [fertility.script_of(t) for t in ("", "12 %", "abc é", "абв x", "日本語", "ひらがな", "한국", "αβγ", "עברית")] == [
        "none", "none", "latin", "cyrillic", "han", "kana", "hangul", "greek", "hebrew"]


def test_empty_table_repeated_rows_and_clashing_names(spark, docs, empty, no_ids):
    assert fertility.quality(empty).collect() == []
    assert fertility.quality(no_ids).count() == no_ids.count()
    named = docs.withColumnRenamed("text", "n.words").withColumnRenamed("doc_id", "entropy").withColumnRenamed("lang", "script")
    again = fertility.quality(named, text="n.words", doc_id="entropy", lang="script").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, fertility.quality(docs).collect()))


def test_a_small_language_leans_on_its_script(spark):
    rows = [(i, " ".join(f"w{i * 60 + j} and more" for j in range(60)), "aa" if i else "bb", None) for i in range(60)]
    measured = fertility.with_base(fertility.measure(frame(spark, rows)))
    found = {r.lang: r for r in fertility.bands(measured).collect()}
    alone = {r.lang: r for r in fertility.bands(measured, lean=0).collect()}
    assert alone["bb"].chars_per_token_width == pytest.approx(20)
    near = abs(found["bb"].chars_per_token_centre - found["aa"].chars_per_token_centre)
    assert near <= abs(alone["bb"].chars_per_token_centre - alone["aa"].chars_per_token_centre)
