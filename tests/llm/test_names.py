import pytest

from gridloom.llm.names import Rules, agreement, by_sound, entity_names, forms, link_mentions, shortened

GENERIC = ["benjamin", "stephen", "elizabeth", "textiles", "power", "systems", "foundation", "research", "associates", "charitable", "trust", "chamber", "commerce", "logistics", "agro", "products"]


@pytest.fixture(scope="module")
def rules():
    return Rules(GENERIC)


@pytest.mark.parametrize(
    ("name", "core", "words", "legal"),
    [
        ("M/s. Zunara Tex. (P) Ltd.", "zunara", ["textiles"], "pvt"), ("ZUNARATEXTILES L.L.P.", "zunara", ["textiles"], "llp"), ("Zuna ra Power Sys Limited", "zunara", ["power", "systems"], "ltd"),
        ("Mr. Steve B. Korvandel", "korvandel", ["stephen", "b."], ""), ("Korvandel, Liz", "korvandel", ["elizabeth"], ""), ("Kor-vandel Benjamn", "korvandel", ["benjamin"], ""), ("the said party", "saidparty", [], ""),
        ("Bonaru Assocs", "bonaru", ["associates"], ""), ("Bonaru Charity Trust", "bonaru", ["charitable", "trust"], ""), ("", "", [], ""),
    ],
)
def test_rewritings(rules, name, core, words, legal):
    p = rules.parse(name)
    assert (p["core"], p["words"], p["legal"]) == (core, words, legal)


def test_forms_meet_within_one_letter():
    a = {f for f in forms("korvandel", []) if f[0] == "3"}
    for other in ("korvandal", "korvande", "korvanndel", "kovrandel"):
        assert a & {f for f in forms(other, []) if f[0] == "3"}, other
    assert not a & {f for f in forms("tirvandos", []) if f[0] == "3"}
    assert by_sound("zeephoos") == by_sound("jifus") and len(shortened("abc")) == 4 and forms("", ["x"]) == set()


def test_a_word_without_counterpart_weighs_against():
    assert agreement(["stephen"], "", ["stephen"], "", False) > agreement(["s."], "", ["stephen"], "", False) > 0
    assert agreement(["textiles"], "ltd", ["power"], "ltd", True) < -5
    assert agreement([], "ltd", [], "llp", True) < agreement([], "", [], "llp", True) < agreement([], "llp", [], "llp", True)


ENTITY = "unique_entity_id string, entity_type string, canonical_name string, name_variants string, aliases array<string>, form string"
MENTION = "occurrence_id long, surface string, entity string, df int"


def entities():
    first = ["Stephen", "Benjamin", "Elizabeth", "Theodora", "Madhavi"]
    trades = ["Textiles Limited", "Power Systems LLP", "Logistics Private Limited"]
    out = []
    stems = [a + b for a in ("Kor", "Zun", "Mip", "Dof", "Heg", "Tov", "Pal", "Rus", "Ven", "Lob") for b in ("vandel", "aralo", "utelga", "arinu")]
    for i, stem in enumerate(stems):
        out.append((f"p{i}", "Person", f"{first[i % 5]} {stem}", None, None, "x"))
        out.append((f"c{i}", "Company", f"{stem}ex {trades[i % 3]}", "not json" if i else '["The Old Firm"]', ["Alias Nine"] if i == 9 else None, "x"))
    return [*out, ("p0", "PERSON", "STEPHEN KORVANDEL", "[]", [], "x"), ("q0", "Person", "Benjamin Korvandel", None, None, "x"), ("n", None, None, None, None, "x"), (None, "Person", "No Key", None, None, "x")]


def linked(spark, mentions, ents=None):
    known = entity_names(spark.createDataFrame(entities() if ents is None else ents, ENTITY))
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in enumerate(mentions)], MENTION)
    return {(r.occurrence_id, r.entity) for r in link_mentions(df, known, "occurrence_id", "surface").collect()}


def test_links(spark):
    mentions = ["Steve Korvandel", "Korvandel", "S. Korvandel", "Zunaralo S.", "Korutlga Elizabeth", "KORARALOEX POWER SYS", "Koraraloex", "the old firm", "alias nine", None, "  ", "the said party", "Nobody Whatsoever", "Zunaralo S.", "x" * 5000]
    assert linked(spark, mentions) == {(0, "p0"), (2, "p0"), (3, "p5"), (4, "p2"), (5, "c1"), (6, "c1"), (7, "c0"), (8, "c9"), (13, "p5")}


def test_empty_sides(spark):
    assert linked(spark, []) == set()
    assert linked(spark, ["Steve Korvandel"], []) == set()


def test_resolved_mentions_are_found_again(spark, sf):
    d = sf.replace("0.001", "0.01")
    known = entity_names(spark.read.parquet(f"{d}/entities.parquet"))
    gold = spark.read.parquet(f"{d}/occurrences.parquet").where("entity_id is not null and surface is not null and entity_id <> '0621602ab930f272'")
    out = gold.join(link_mentions(gold, known, "occurrence_id", "surface"), "occurrence_id", "left").selectExpr("count(*) n", "sum(int(entity = entity_id)) right", "sum(int(entity <> entity_id)) wrong").first()
    assert out.right >= 0.97 * out.n and out.wrong <= 0.01 * out.n


def shared_core(core):
    """Every pair of 18 given names before one surname, and enough others to keep the surname's share at any level."""
    first = ["Robert", "Kamala", "Asha", "Chetan", "Divya", "Esha", "Farid", "Girish", "Harish", "Indira", "Lalit", "Mohan", "Nitin", "Omkar", "Pooja", "Suresh", "Tarun", "Umesh"]
    return [(f"h{i}_{j}", "Person", f"{a} {b} {core}", None, None, "x") for i, a in enumerate(first) for j, b in enumerate(first) if i < j]


COMMON_ASKED = ["Bob Kamala Patel", "R. K. Patel", "Robert Kamala Pattel", "Patel", "Robert Patel", "Patel, Asha Chetan", "Robert Zzyzx Patel"]
COMMON_FOUND = {(0, "h0_1"), (1, "h0_1"), (2, "h0_1"), (5, "h2_3")}


def test_a_word_shared_by_a_third_of_the_entities(spark):
    """A surname so common that it counts as generic: names without a rare part still meet, ties stay unlinked."""
    assert linked(spark, COMMON_ASKED, entities() + shared_core("Patel")) == COMMON_FOUND


def test_forms_shared_by_more_entities_than_the_limit(spark, monkeypatch):
    """The same with a surname that is a rare part in itself, in forms of few and of many shapes, gives the same links."""
    from gridloom.llm import names as module

    given = sorted({w.lower() for e in shared_core("") for w in e[2].split()})
    monkeypatch.setattr(module, "generic_words", lambda df: given)
    ents = shared_core("Patel") + [(f"i{k}", "Person", f"Robert Q{k}x Patel", None, None, "x") for k in range(120)]
    got = {}
    for limit in (3, module.COMMON, 10**9):
        monkeypatch.setattr(module, "COMMON", limit)
        got[limit] = linked(spark, [*COMMON_ASKED, "Robert Q7x Patel", "B. Q7x Patel"], ents)
    assert got[3] == got[10**9] == got[200] and got[3] >= COMMON_FOUND


def test_rewritings_of_recorded_aliases_are_linked(spark):
    """Misspelled, abbreviated and respelled aliases, and an exact one with a trade that the canonical name lacks."""
    aliases = [("a1", "Company", "Quembrilux Ltd", '["Thornwickel Tex"]', ["the Holding Company", "Brazzonike Textiles"], "x")]
    asked = ["The Holding Compny", "Holding Co.", "The Holdng Company", "BRAZZONIKE TEXTILES", "Brazonnike Tex.", "Thornwickel Textiles", "The Holding Zzyzx"]
    assert linked(spark, asked, entities() + aliases) == {(i, "a1") for i in range(6)}
