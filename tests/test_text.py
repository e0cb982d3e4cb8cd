import pytest
from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.functions import text
from linkloom.functions.translit import to_latin

NAMES = [
    ("-- Holloway Peak Inc Seafood", "holloway peak seafood", "inc"), ("RAM MARKETING PVT. LTD.", "ram marketing", "ltd pvt"),
    ("राम मार्केटिंग प्राइवेट लिमिटेड", "ram marketing", "ltd pvt"), ("कृष्ण सूर्य ट्रेडर्स", "krishna surya tredars", ""),
    ("ಮಹೇಶ್ ಎಂಟರ್‌ಪ್ರೈಸಸ್", "mahesh entarpraisas", ""), ("L.L.C. Moncada Trucking", "moncada trucking", "llc"),
    ("www.wilfordhancock.com", "wilfordhancock", ""), ("Lord's Bakery & Cafe", "lords bakery and cafe", ""), ("Pr0perties Group Corp", "properties group", "corp"),
    ("M/S Shree Ganesh Traders", "shree ganesh traders", ""), ("Café Élite SARL", "cafe elite", "sarl"), ("LLC", "llc", "llc"), ("", "", ""),
]


def test_names(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(NAMES)] + [(99, None)], "i int, n string")
    _, core, legal = text.name_parts(F.col("c"))
    got = {r.i: (r.core, r.legal) for r in df.withColumn("c", text.basic_clean(F.col("n"))).select("i", core.alias("core"), legal.alias("legal")).collect()}
    assert got == {i: x[1:] for i, x in enumerate(NAMES)} | {99: ("", "")}


def test_addresses(spark):
    same = [("01018 KENWOOD ST, HAMMOND, IN", "1018 Kenwood St, Hammond, Indiana"), ("12 MG Rd, Bengaluru, Karnataka 560001", "12 M.G. Road, Bengaluru, KA 560001")]
    df = spark.createDataFrame(same, "a string, b string")
    for r in df.select(text.clean_address(text.basic_clean(F.col("a"))).alias("a"), text.clean_address(text.basic_clean(F.col("b"))).alias("b")).collect():
        assert r.a == r.b


def test_keys(spark):
    df = spark.createDataFrame([("Alpha Trading Pvt. Ltd. (id:123456)", "12 High St, 12"), ("www.beta.com", "none"), ("gama gama stores", "7 9 7")], "n string, a string")
    got = df.select(text.rival_key(text.plain(F.col("n"))).alias("n"), text.digit_key(F.col("a")).alias("a")).collect()
    assert [tuple(r) for r in got] == [("alpha trading", "12"), ("", ""), ("gama stores", "7 9")]


def test_sound_postcode_typos(spark):
    one = spark.createDataFrame([("shivam ventures", "12 main road 07030 town 560001", "5ervices lndia 3rd 24x7")], "a string, b string, c string")
    r = one.select(text.sound_skeleton(F.col("a")), text.postcode(F.col("b")), text.first_number(F.col("b")), text.fix_typos(F.col("c"))).first()
    assert tuple(r) == ("svm vntrs", "560001", "12", "services india 3rd 24x7")


def test_to_latin():
    assert to_latin("शिवम वेंचर्स") == "shivam venchars" and to_latin("कंपनी") == "kampani" and to_latin("Straße Œuvre") == "strasse oeuvre"


@pytest.mark.parametrize("a,b,want", [("", "", 100.0), ("abc", "", 0.0), ("kitten", "sitting", 200 * 4 / 13), ("ab", "ba", 50.0)])
def test_ratio(a, b, want):
    assert S.ratio(a, b) == pytest.approx(want)


def test_ratio_against_dynamic_programming():
    import itertools

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    words = ["".join(w) for n in range(4) for w in itertools.product("ab", repeat=n)] + ["abracadabra", "cadabraabra"]
    assert all(S.lcs(a, b) == slow(a, b) for a in words for b in words)


def test_token_and_partial_kernels():
    assert S.token_sort_ratio("b a", "a b") == 100 and S.token_set_ratio("a b", "a b c") == 100 and S.token_set_ratio("", "a") == 0
    assert S.partial_ratio("abc", "xxabcxx") == 100 and S.partial_ratio("", "") == 100 and S.partial_ratio("abd", "xabcx") == pytest.approx(100 * 4 / 6)
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6) and S.jaro_winkler("", "") == 1


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def plain_partial(a, b):
    ways = [(a, b), (b, a)] if len(a) == len(b) else [sorted((a, b), key=len)]
    return max(200 * plain_lcs(s, w) / (len(s) + len(w)) for s, t in ways for e in range(1, len(t) + len(s)) for w in [t[max(0, e - len(s)) : e]])


def plain_jaro_winkler(a, b):
    reach, used, hits = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            hits.append(c)
    if not hits:
        return 0.0
    m, swaps = len(hits), sum(x != b[j] for x, j in zip(hits, sorted(used))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = next((i for i in range(4) if a[i : i + 1] != b[i : i + 1] or not a[i : i + 1]), 4)
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


def test_kernels_against_plain_definitions_on_longer_texts():
    import random

    pick = random.Random(5)
    for letters in ("ab", "abc de", "abcdefgh\u00e9\U0001f600 "):
        for sizes in ((30, 80), (60, 60), (25, 26), (5, 40), (24, 24), (1, 300)):
            a, b = ("".join(pick.choice(letters) for _ in range(n)) for n in sizes)
            assert S.lcs(a, b) == S.lcs(b, a) == plain_lcs(a, b)
            assert S.partial_ratio(a, b) == pytest.approx(plain_partial(a, b)) and S.partial_ratio(b, a) == S.partial_ratio(a, b)
            assert S.jaro_winkler(a, b) == pytest.approx(plain_jaro_winkler(a, b))
    assert S.partial_ratio("abab", "xabx") == S.partial_ratio("xabx", "abab") == pytest.approx(200 / 3)  # either text may give the window


def test_both_ways_to_score_windows_agree():
    import random

    pick = random.Random(6)
    for _ in range(200):
        a, b = sorted(("".join(pick.choice("abcd ") for _ in range(pick.randint(1, 40))) for _ in range(2)), key=len)
        assert S._windows(a, b) == pytest.approx(S._combed_windows(a, b))
