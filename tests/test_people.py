"""Names of a directory in free text against a plain search of every name at every word."""

import random
import re

from pyspark.sql import functions as F

from lendflow.functions.text import mask_pii
from lendflow.operators import people, privacy

SEED_WORDS = ["ann", "lee", "van", "der", "berg", "wei", "chen", "7", "o", "maria", "da", "silva", "zoë", "li"]


def _words(text):
    return [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text or "")]


def brute_occurrences(text, names):
    ws = _words(text)
    keys = {tuple(w for w, _, _ in _words(n)) for n in names} - {()}
    return sorted((i, len(k), " ".join(k)) for k in keys for i in range(len(ws) - len(k) + 1)
                  if tuple(w for w, _, _ in ws[i:i + len(k)]) == k)


def brute_mask(text, names):
    if text is None:
        return None
    ws, out, done, spans = _words(text), [], 0, []
    for start, n, _ in brute_occurrences(text, names):
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], start + n)
        else:
            spans.append([start, start + n])
    for lo, hi in spans:
        out += [text[done:ws[lo][1]], "<PERSON>"]
        done = ws[hi - 1][2]
    return "".join(out) + text[done:]


def _directory(spark, names):
    return spark.createDataFrame([(f"A{i}", n) for i, n in enumerate(names)], "application_id string, real_name string")


def _random_texts(rng, n):
    glue = [" ", ", ", "-", ". ", "\n", "  #"]
    return ["".join(rng.choice([w, w.upper(), w.title()]) + rng.choice(glue)
                    for w in rng.choices(SEED_WORDS, k=rng.randint(0, 40))) for _ in range(n)]


def _check(spark, texts, names):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = people.find_people(rows, _directory(spark, names), "t", ("id",)).collect()
    got = {}
    for r in found:
        got.setdefault(r.id, []).append((r.start, r.n, r.person))
    assert {k: sorted(v) for k, v in got.items()} == {
        i: o for i, o in ((i, brute_occurrences(t, names)) for i, t in enumerate(texts)) if o}
    masked = {r.id: r.t for r in people.mask_people(rows, _directory(spark, names), "t").collect()}
    assert masked == {i: brute_mask(t, names) for i, t in enumerate(texts)}


def test_all_names_at_all_places(spark):
    rng = random.Random(5)
    names = [" ".join(rng.choices(SEED_WORDS, k=rng.randint(1, 4))) for _ in range(60)]
    names += ["", None, "  ", "--", names[0], names[0].upper(), "Berg, Van-der", "Zoë Li"]
    _check(spark, _random_texts(rng, 300) + [None, "", "...", "x", "Ann"], names)


def test_a_full_bitmap_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(people, "MAX_BITS", 15)
    rng = random.Random(6)
    names = [f"n{i} m{rng.randint(0, 50)} k{i % 7}" for i in range(20_000)]
    trie = people.NameTrie(_directory(spark, names))
    assert trie.bits == 15 and trie.longest == 3
    texts = [" ".join(rng.choice([f"n{rng.randint(0, 30_000)}", f"m{rng.randint(0, 60)}", f"k{rng.randint(0, 8)}", names[i * 9]])
                      for _ in range(30)) for i in range(100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    places = rows.select("id", F.explode(trie.spans("t"))).count()
    got = sorted((r.id, r.start, r.person) for r in people.find_people(
        rows, _directory(spark, names), "t", ("id",), trie=trie).collect())
    keys = set(names)
    want = sorted((i, j, " ".join(ws[j:j + 3])) for i, ws in ((i, t.split()) for i, t in enumerate(texts))
                  for j in range(len(ws) - 2) if " ".join(ws[j:j + 3]) in keys)
    assert got == want and places > len(want) > 0


def test_a_shared_first_word_and_a_name_in_every_text(spark):
    # Every name begins alike, one name stands in every text and one text holds it thousands of times.
    names = [f"Customer#{i:09d}" for i in range(3_000)]
    texts = ["Customer#000000007 and customer 000000008, Customer"] * 500 + ["customer#000000007 " * 5_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4)
    masked = {r.id: r.t for r in people.mask_people(rows, _directory(spark, names), "t").collect()}
    assert masked[0] == "<PERSON> and <PERSON>, Customer" and masked[500] == "<PERSON> " * 5_000
    assert len(masked) == 501


def test_rows_and_columns_stay(spark):
    names = _directory(spark, ["Ann Lee"])
    rows = spark.createDataFrame([("ann lee", 1, "a", "p"), ("ann lee", 1, "a", "p"), (None, 2, "b", "q")],
                                 "`t.x` string, rid int, row string, places string")
    out = people.mask_people(rows, names, "t.x")
    assert out.schema.names == rows.schema.names
    assert sorted(out.collect(), key=str) == sorted([("<PERSON>", 1, "a", "p")] * 2 + [(None, 2, "b", "q")], key=str)
    none = names.limit(0)
    assert people.mask_people(rows, none, "t.x").collect() == rows.collect()
    assert people.find_people(rows, none, "t.x", ("rid",)).columns == ["rid", "rid", "start", "n", "person"]
    assert people.mask_people(rows.limit(0), names, "t.x").collect() == []


def test_other_people_leave_notes_and_the_audit_sees_them(spark):
    apps = spark.createDataFrame(
        [("A0", "Ann Lee", "Ann Lee with Wei Chen; ann's brother"), ("A1", "Wei Chen", "Lee signs, chen.wei@x.com"),
         ("A2", None, "see ANN LEE"), ("A3", "Maria Silva", None)],
        "application_id string, applicant_name string, applicant_notes string")
    names = _directory(spark, ["Ann Lee", "Wei Chen"])
    got = {r.application_id: r.applicant_notes for r in privacy.mask_applications(apps, names).collect()}
    assert got == {"A0": "<PERSON> with <PERSON>; <PERSON>'s brother", "A1": "Lee signs, <EMAIL>",
                   "A2": "see <PERSON>", "A3": None}
    rows = apps.withColumnRenamed("applicant_notes", "raw").withColumn("blank", F.lit("nothing"))
    found = {(r.column_name, r.leak_kind): (r.n_rows, r.n_checked)
             for r in privacy.leak_audit(rows, names, ["raw", "blank"]).collect()}
    assert found["raw", "OTHER_NAME"] == (2, 4) and found["blank", "OTHER_NAME"] == (0, 4)


def test_no_part_of_the_directory_is_broadcast(spark):
    names = [f"Customer#{i:09d}" for i in range(50)]
    rows = spark.createDataFrame([(i, f"seen by {n}") for i, n in enumerate(names)], "id long, t string")
    found = people.find_people(rows, _directory(spark, names), "t", ("id",))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 50


def test_only_frequent_names_are_spread(spark, monkeypatch):
    # One name at most places, others once or twice: the frequent one alone is in 32 parts, with the same result.
    names = [f"Customer#{i:09d}" for i in range(300)]
    rows = spark.createDataFrame([(i, f"customer 000000007, {names[i % 300]}") for i in range(600)], "id long, t string")

    def found():
        return people.find_people(rows, _directory(spark, names), "t", ("id",))
    want = sorted(map(tuple, found().drop("rid").collect()))
    assert len(want) == 1200
    monkeypatch.setattr(people, "FREQUENT", 100)
    assert sorted(map(tuple, found().drop("rid").collect())) == want
    persons = spark.createDataFrame([("a", 101, 40), ("b", 100, 40), ("c", 1, 7)], "person string, places long, rid long")
    part, parts = people._salts(persons)
    assert [tuple(r) for r in persons.select("person", part, F.size(parts)).collect()] == [("a", 8, 32), ("b", 0, 1), ("c", 0, 1)]
    monkeypatch.setattr(people, "MOST_FREQUENT", 1)                # more than all places: none
    assert [r[0] for r in persons.select(F.size(people._salts(persons)[1])).collect()] == [1, 1, 1]


def test_the_audit_masks_and_joins_its_rows_once(spark):
    """Rows of the audit are read twice; what made them runs once."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        calls.add(1)
        return x
    rows = spark.createDataFrame([(f"A{i}", "by Ann Lee") for i in range(20)], "application_id string, raw string")
    rows = rows.withColumn("notes", seen.asNondeterministic()("raw"))
    names = _directory(spark, ["Ann Lee", "Wei Chen"])
    got = {(r.column_name, r.leak_kind): r.n_rows for r in privacy.leak_audit(rows, names, ["raw", "notes"]).collect()}
    assert got["notes", "OTHER_NAME"] == got["raw", "OTHER_NAME"] == 19 and got["notes", "NAME"] == 1
    assert calls.value == 20


PLAIN_PII = (("<EMAIL>", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"),
             ("<CARD>", r"(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9])"),
             ("<PHONE>", r"(?<![0-9])(?:(?:[+]?[0-9]{1,2} ?)?[(][0-9]{3}[)] ?[0-9]{3}-[0-9]{4}"
                         r"|(?:[+]?61 ?)?[(]0?[2378][)][ -]?[0-9]{4}[ -]?[0-9]{4}"
                         r"|(?:[+]61 ?|0)[2378][ -]?[0-9]{4}[ -]?[0-9]{4}"
                         r"|(?:[+]61 ?|0)4[0-9]{2}[ -]?[0-9]{3}[ -]?[0-9]{3}"
                         r"|1[38]00[ -]?[0-9]{3}[ -]?[0-9]{3}|13 ?[0-9]{2} ?[0-9]{2})(?![0-9])"))


def test_the_quicker_patterns_mask_what_the_plain_ones_do(spark):
    rng = random.Random(7)
    bits = ["a", "b.c", "x_y", "@", "@d.co", ".com", "1", "13", "1300", "0412", "345", "678", "(02)", "(555) ", "-", " ", "+61 ",
            "4111", "1234", "é", "%", "a@b.co1x@d.com", "\n", "12 34", "61", "555-1234"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(20_000)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("masked", mask_pii("t"))
    plain = F.col("t")
    for token, pattern in PLAIN_PII:
        plain = F.regexp_replace(plain, pattern, token)
    both = rows.withColumn("plain", plain).collect()
    assert [r.masked for r in both] == [r.plain for r in both]
    assert all(sum(token in (r.plain or "") for r in both) > 100 for token, _ in PLAIN_PII)
