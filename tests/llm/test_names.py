import pytest

from corpuslane.llm.names import jaro_winkler, link_journals, link_persons, parse_journal, parse_person, person_keys, variant_pairs


def test_jaro_winkler_known_values():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1


def test_slips_share_a_block():
    for given in ("hugo", "clara", "wilhelm", "alexandrina"):
        keys = {k for k, _ in person_keys("torvald", given)}
        for i in range(len(given) + 1):
            for w in (given[:i] + given[i + 1 :], given[:i] + "q" + given[i + 1 :], given[:i] + "q" + given[i:], given[:i] + given[i : i + 2][::-1] + given[i + 2 :]):
                assert keys & {k for k, _ in person_keys("torvald", w)}, (given, w)


def test_a_frequent_surname_stays_near_linear(spark):
    """20 000 persons of one surname."""
    import random

    from corpuslane.llm import names

    rng = random.Random(1)
    parts = ["an", "be", "cla", "da", "el", "fri", "ga", "hu", "is", "jo", "ka", "lu", "mar", "ni", "ol", "pe", "ri", "so", "ta", "ul", "vi", "we", "xa", "yo", "ze"]
    given = set()
    while len(given) < 20_000:
        given.add("".join(rng.choice(parts) for _ in range(4)))
    rows = [(f"wang|{g}|", "wang", g, k) for g in given for k, _ in person_keys("wang", g)]
    sides = [x for g in given for _, x in person_keys("wang", g)]
    df = spark.createDataFrame([(n, k, x) for (n, _, _, k), x in zip(rows, sides, strict=True)], "node string, key string, side int")
    df = df.unionByName(spark.createDataFrame([(f"wang|{x}|", k, s) for x in "abcdefghij" for k, s in person_keys("wang", x)], "node string, key string, side int"))
    pairs = names._pairs_in_blocks(df, ["node"]).count()
    assert pairs < 60 * len(given), pairs


@pytest.mark.parametrize(
    ("name", "reading"),
    [
        ("Torvald, Anna B.", ("torvald", "anna", "b")), ("TORVALD, ANNA", ("torvald", "anna", "")), ("A. B. Torvald", ("torvald", "a", "b")), ("Torvald AB", ("torvald", "a", "b")),
        ("Torvald A", ("torvald", "a", "")), ("Torvald, Anna, MD", ("torvald", "anna", "")), ("Anna B. Torvald", ("torvald", "anna", "b")), ("Müller-Søgaard, Zoë", ("muller sogaard", "zoe", "")),
    ],
)
def test_readings(name, reading):
    assert parse_person(name)[0][:3] == reading


@pytest.mark.parametrize("name", ["", "et al.", "Et al", "Northern Bay Study Group", " , "])
def test_nobody(name):
    assert parse_person(name) == []


PEOPLE = {
    "anna": ["Torvaldsen, Anna B.", "torvaldsen, anna", "A. Torvaldsen", "Torvaldsen AB", "Anna Torvaldsen", "Torvaldsen, Ana", "Torvalsden, Anna"],
    "robert": ["Torvaldsen, Robert", "Bob Torvaldsen", "Torvaldsen, R.", "Torvaldsen  Robert"],
    "rosa": ["Okonjo, Rosa", "OKONJO, ROSA, MD"],
    "clara": ["Okonjo, Clara", "Okonjo, C."],
    "ines": ["Dell-Monte, Inés", "Dell Monte, Ines", "Monte-Dell, Inés"],
}


def test_persons(spark):
    rows = [(n, 5) for names in PEOPLE.values() for n in names]
    # given names and families that the collection knows well
    rows += [(f"{s}, {g}", 3) for s in ("Brzel", "Quist", "Harkavy", "Ilves") for g in ("Anna", "Robert", "Rosa", "Clara", "Inés", "Jonas")]
    rows += [("Torvaldsen, Jonas", 4), ("Okonjo, Jonas", 4), ("et al.", 9), ("", 3), (None, 2), ("Bay Study Group", 2)]
    c = link_persons(spark.createDataFrame(rows, "name string, n bigint")).toPandas().set_index("name").cluster
    for names in PEOPLE.values():
        assert c[names].nunique() == 1, names
    assert len({c[v[0]] for v in PEOPLE.values()}) == len(PEOPLE)
    assert not {"et al.", "", "Bay Study Group"} & set(c.index)


def test_ambiguous_initials_stay_alone(spark):
    rows = [("Okonjo, Rosa", 5), ("Okonjo, Robert", 5), ("Okonjo, R.", 2)]
    c = link_persons(spark.createDataFrame(rows, "name string, n bigint")).toPandas().cluster
    assert c.nunique() == 3
    assert link_persons(spark.createDataFrame([], "name string, n bigint")).count() == 0


JOURNALS = {
    1: ["Archives of Renal Pathology", "archives of renal pathology.", "Renal Pathology, Archives of", "Arch. Ren. Pathol.", "Archives of Rebal Pathology", "Archives of Rena lPathology"],
    2: ["Archives of Renal Pathology and Imaging", "Arch Ren Pathol Imag", "Archives of Renal Pathology & Imaging"],
    3: ["Journal of Dermal Nursing", "J. Dermal Nurs.", "Jnl of Dermal Nursing", "Journal of Dermal Nursing (Online)"],
    4: ["Annals of Dermal Nursing", "Ann. Derm. Nurs."],
}


def test_journals(spark):
    rows = [(n, 3) for v in JOURNALS.values() for n in v] + [("Annals of Renal Imaging", 9), ("Journal of Renal Nursing", 9), ("Journal of Dermal Pathology", 9), (None, 1), (" ", 1)]
    c = link_journals(spark.createDataFrame(rows, "name string, n bigint").where("name is not null")).toPandas()
    k = c.set_index("name").cluster
    for v in JOURNALS.values():
        assert k[v].nunique() == 1, v
    assert len({k[v[0]] for v in JOURNALS.values()}) == 4
    assert parse_journal("  Proceedings & Notes, Journal of ") == "journal of proceedings and notes"
    pairs = variant_pairs(spark.createDataFrame(c)).collect()
    assert len(pairs) == sum(len(v) * (len(v) - 1) // 2 for v in JOURNALS.values()) and all(a < b for a, b in pairs)


def test_one_slip_in_several_journals(spark):
    right = ["Archives of Renal Pathology", "Journal of Dermal Pathology", "Annals of Clinical Pathology", "Reviews in Surgical Pathology"]
    rows = [(t, 40) for t in right] + [(t.replace("Pathology", "Pathlogy"), 2) for t in right]
    # two words that are one slip apart, both well established
    apart = [f"{a} of {b} Disease" for a in ("Journal", "Annals", "Archives") for b in ("Nasal", "Basal")]
    k = link_journals(spark.createDataFrame(rows + [(t, 9) for t in apart], "name string, n bigint")).toPandas().set_index("name").cluster
    for t in right:
        assert k[t] == k[t.replace("Pathology", "Pathlogy")], t
    assert k.nunique() == len(right) + len(apart)
