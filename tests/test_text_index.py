"""The stemmer against published vocabulary pairs, and the name indexes against plain scans."""

import random

from pyspark.sql import functions as F

from wattle.functions.stemming import STOP_WORDS, stem
from wattle.functions.text import escape_like
from wattle.operators import text_index as X

# Word and stem pairs as published with the algorithm.
PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag
knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
happy happi cry cri by by say say hopping hop hoping hope luxuriated luxuri ties tie cries cri gas gas this this gaps gap kiwis kiwi dying die news news generally general""".split()


def test_published_stems():
    assert [(w, stem(w)) for w in PUBLISHED[::2]] == list(zip(PUBLISHED[::2], PUBLISHED[1::2]))
    assert len(STOP_WORDS) == 127 and "the" in STOP_WORDS


def test_index_equals_scan(spark, tmp_path):
    rng = random.Random(5)
    words = ["High", "Schools", "school", "technologies", "Technology", "The", "of", "St.", "O'Brien", "100%", "a_b", "Girls", "girl", "École", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))), "k") for i in range(300)] + [(500, None, "k"), (501, "", "k"), (502, "ab", "k")]
    df = spark.createDataFrame(rows, "nr int, label string, id string")
    X.build(df, "nr", "label", str(tmp_path / "index"))
    index = X.NameIndex(spark, str(tmp_path / "index"))
    split = lambda t: {stem(w) for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() if w not in STOP_WORDS}
    for query in ("high school", "the technologies of girls", "SCHOOLS", "nowhere school", "the of", "", "école"):
        want = sorted(i for i, t, _ in rows if split(query) and split(query) <= split(t))
        assert sorted(r.id for r in index.matching(query).collect()) == want, query
    for part in ("school", "HIGH SCH", "100%", "_b", "x", "", "zzz", "é", "echnologie", "a_b s"):
        want = sorted(i for i, t, _ in rows if t is not None and part.upper() in t.upper())
        assert sorted(r.id for r in index.containing(part).collect()) == want, part
    assert sorted(r.id for r in index.starting("high s").collect()) == sorted(i for i, t, _ in rows if t and t.upper().startswith("HIGH S"))
    plan = index.starting("high s")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(upper" in plan  # reaches the scan
    plan = index.matching("high school")._jdf.queryExecution().executedPlan().toString()
    assert "In(stem" in plan and "names" not in plan


def test_positions(spark):
    df = spark.createDataFrame([(1, "The high schools of Highs")], "id int, name string")
    assert sorted(map(tuple, X.postings(df, "id", "name").collect())) == [("high", 1, 2), ("high", 1, 5), ("school", 1, 3)]
