import random

import numpy as np
from pyspark.sql import functions as F

from linkforge.functions import edit as E
from linkforge.functions import similarity as S
from linkforge.functions import text as X


def test_normal_forms(spark):
    rows = ["A & B Co.", "Foo.com Pvt Ltd", "Café Straße", "ＡＢＣ Corp", "", "a_b", "x y", "Tata.co.in LLP"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(X.name_form(X.fold("v"))).collect()]
    assert got == ["a and b company", "foo private limited", "cafe strasse", "abc corporation", "", "a_b", "x y", "tata limited"]


def test_tokens_keep_repeats_and_order(spark):
    df = spark.createDataFrame([("foo foo the limited bar ab", "12 123 123 4567")], "n string, a string")
    r = df.select(X.sig_tokens(F.col("n")), X.nums(F.col("a")), X.sorted_sig(F.col("n")), X.prefix(F.col("n"), 4, 4)).first()
    assert list(r) == [["foo", "foo", "bar"], ["123", "123", "4567"], "bar foo", "foof"]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_ratio_is_indel():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ("".join(draw.choices("abcd ", k=draw.randint(0, 12))) for _ in "ab")
        want = 100.0 if not a and not b else 200 * _lcs(a, b) / (len(a) + len(b))
        assert abs(S.ratio(a, b) - want) < 1e-9


def test_edit_measures_on_known_cases():
    assert S.token_sort_ratio("new york mets", "mets york new") == 100
    assert S.token_set_ratio("a b", "a b c") == 100 and S.token_set_ratio("", "a") == 0
    assert S.partial_ratio("york", "new york mets") == 100 and S.partial_ratio("", "") == 100
    assert abs(S.jaro_winkler("martha", "marhta") - 0.961111) < 1e-6 and S.jaro_winkler("", "x") == 0


def test_set_measures_and_their_conventions(spark):
    df = spark.createDataFrame([([], []), (["1"], []), (["1", "2"], ["2", "3"])], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = df.select(S.jaccard(a, b), S.jaccard(a, b, 1.0), S.containment(a, b), S.number_overlap(a, b), S.number_conflict(a, b)).collect()
    assert [tuple(round(x, 4) for x in r) for r in got] == [(0, 1, 0, 0, 0), (0, 0, 0, 0, 0), (0.3333, 0.3333, 0.5, 0.3333, 0)]


def _partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    one = lambda x, y: max(200 * _lcs(x, w) / (len(x) + len(w)) for k in range(1 - len(x), len(y)) if (w := y[max(k, 0) : k + len(x)]))
    return one(a, b) if len(a) < len(b) else one(b, a) if len(b) < len(a) else max(one(a, b), one(b, a))


def _token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    if both and (not left or not right):
        return 100.0
    plain = lambda p, q: 200 * _lcs(p, q) / (len(p) + len(q))
    return max([plain(one, two)] + [plain(both, one), plain(both, two)] * bool(both))


def test_batch_measures_by_dynamic_programming(monkeypatch):
    """Strings of one and of several words of bits, tiles of a few pairs, letters of many alphabets."""
    draw = random.Random(5)
    for longest, letters, tile in ((9, "ab ", 8192), (20, "abcdé 漢😀 ", 7), (80, "abc def", 64), (150, "abcdefghij  ", 8192)):
        monkeypatch.setattr(E, "PAIRS", tile)
        monkeypatch.setattr(E, "WINDOWS", 50 * tile)
        first, second = ([""] + ["".join(draw.choices(letters, k=draw.randint(1, longest))) for _ in range(14)] for _ in "ab")
        second += first[:4]
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(first)), np.arange(len(second))))
        at = range(len(i)) if longest < 50 else draw.sample(range(len(i)), 25)
        sort = lambda s: " ".join(sorted(s.split()))
        indel = lambda a, b: 200 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
        rules = {E.ratio: indel, E.token_sort_ratio: lambda a, b: indel(sort(a), sort(b)), E.token_set_ratio: _token_set, E.partial_ratio: _partial}
        for measure, rule in rules.items():
            got = measure(first, second, i, j)
            assert all(abs(got[k] - rule(first[i[k]], second[j[k]])) < 1e-9 for k in at)
        got = E.jaro_winkler(first, second, i, j)
        assert all(abs(got[k] - E.jaro_winkler_of(first[i[k]], second[j[k]])) < 1e-12 for k in range(len(i)) if first[i[k]] != second[j[k]])
        assert all(got[k] == 1.0 for k in range(len(i)) if first[i[k]] == second[j[k]])


def test_measures_by_name_in_sql(spark):
    S.register(spark)
    row = spark.sql("SELECT token_sort_ratio('b a', 'a b') AS a, partial_ratio('york', 'new york') AS b, jaro_winkler('', '') AS c, ratio('ab', 'b') AS d").first()
    assert (row["a"], row["b"], row["c"], round(row["d"], 6)) == (1.0, 1.0, 0.0, round(2 / 3, 6))


def test_each_generation_has_its_own_forms(spark):
    rows = [("Café & Bar Pvt Ltd", "12 N Main Rd, Apt 4", " India "), ("Ｆｏｏ.com plc", "7 Rue de l'Étoile Ste 2", "FRANCE"), ("Straße LLP", "", None)]
    df = spark.createDataFrame(rows, "business_name string, business_address string, country string").na.fill("")
    forms = {g: [tuple(r) for r in X.prepare(df, g).select("name_norm", "addr_norm", "country_key", "name_key").collect()] for g in X.FORMS}
    assert forms["v2"][0] == ("cafe and bar private limited", "12 n main road apt 4", "india", "cafe and bar private limited")
    assert forms["v1"][0][0] == "café and bar private limited" and forms["v2"][1][0] == "foo plc" and forms["v1"][1][0] == "foo com plc"
    assert forms["a"][0][1] == "12 north main road apartment 4" and forms["a"][1][0] == "foo com public" and forms["a"][2][0] == "strasse limited"
    assert forms["b"][0] == ("café and bar private limited", "12 n main road apartment 4", "india", "café and bar pvt ltd") and forms["b"][2][0] == "strasse llp"


def test_windows_by_strands_and_token_sets_as_bits_equal_plain_measures(monkeypatch):
    draw = random.Random(3)
    text = lambda letters, n: "".join(draw.choices(letters, k=n))
    wide = [chr(c) for c in range(200, 800)]
    first = ["", *(text("ab c", draw.randint(0, 14)) for _ in range(60)), *(text("abcdé ", draw.randint(90, 150)) for _ in range(10)), *(text(wide, draw.randint(1, 60)) for _ in range(30))]
    second = [*(text("ab c", draw.randint(0, 14)) for _ in range(60)), *(text("abcdé ", draw.randint(90, 150)) for _ in range(10)), *first[-30:], "  a  b ", " ".join(f"t{k}" for k in range(40))]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(first)), np.arange(len(second))))
    partial, sets = E.partial_ratio(first, second, i, j), E.token_set_ratio(first, second, i, j)
    some = np.random.default_rng(1).integers(0, len(i), 300)
    assert all(abs(partial[k] - _partial(first[i[k]], second[j[k]])) < 1e-9 for k in some)
    # Each way gives the same values to the last bit.
    monkeypatch.setattr(E, "_best_by_strands", E._best_by_window)
    monkeypatch.setattr(E, "_token_sets", E._token_sets_singly)
    assert np.array_equal(E.partial_ratio(first, second, i, j), partial) and np.array_equal(E.token_set_ratio(first, second, i, j), sets)


def test_set_sizes_and_tokens_of_one_text_equal_expressions(spark):
    draw = random.Random(5)
    rows = [tuple(" ".join(draw.choices(["foo", "the", "ab", "limited", "bar", "123", "12", "99999", "4567x", "١٢٣", ""], k=draw.randint(0, 9))) for _ in "ab") for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = X.sig_tokens(F.col("a")), X.sig_tokens(F.col("b"))
    want = [tuple(r) for r in df.select(a, X.nums(F.col("a")), F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))).collect()]
    at = np.arange(len(rows))
    sizes = S.set_sizes(*([X.sig_tokens_of(r[k]) for r in rows] for k in (0, 1)), at, at)
    assert [(X.sig_tokens_of(x), X.nums_of(x), *(int(n[k]) for n in sizes)) for k, (x, _) in enumerate(rows)] == want
