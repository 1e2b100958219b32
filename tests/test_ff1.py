"""FF1 against the published sample vectors, as a mask and back."""

import pytest
from pyspark.sql import functions as F

from tablecloak.errors import InvalidRule
from tablecloak.functions import checksums, ff1
from tablecloak.operators.masks import keep, mask_table, rule, unmask_fpe
from tablecloak.plans.registry import SECRET

# The sample vectors published with SP 800-38G: key, tweak, charset, plain text, cipher text.
KEY = "2B7E151628AED2A6ABF7158809CF4F3CEF4359D8D580AA4F7F036D6F04FC6A94"
SAMPLES = [(32, "", "digits", "0123456789", "2433477484"),
           (32, "39383736353433323130", "digits", "0123456789", "6124200773"),
           (32, "3737373770717273373737", "alphanum", "0123456789abcdefghi", "a9tv40mll9kdu509eum"),
           (48, "", "digits", "0123456789", "2830668132"),
           (48, "39383736353433323130", "digits", "0123456789", "2496655549"),
           (48, "3737373770717273373737", "alphanum", "0123456789abcdefghi", "xbj3kv35jrawxv32ysr"),
           (64, "", "digits", "0123456789", "6657667009"),
           (64, "39383736353433323130", "digits", "0123456789", "1001623463"),
           (64, "3737373770717273373737", "alphanum", "0123456789abcdefghi", "xs8a0azh2avyalyzuwd")]


@pytest.mark.parametrize("digits, tweak, charset, plain, sealed", SAMPLES)
def test_published_samples(spark, digits, tweak, charset, plain, sealed):
    key = bytes.fromhex(KEY[:digits])
    df = spark.createDataFrame([(plain, sealed)], "p string, s string")
    there = ff1.ff1_body(F.col("p"), key, charset, bytes.fromhex(tweak))
    back = ff1.ff1_body(F.col("s"), key, charset, bytes.fromhex(tweak), inverse=True)
    assert df.select(there, back).first() == (sealed, plain)


@pytest.mark.parametrize("charset, alphabet", [("digits", "0123456789"), ("alphanum", "0123456789abcdefghijklmnopqrstuvwxyz"), ("ALPHANUM", "09AZaz"), ("vin", "0123456789ABCDEFGH")])
def test_every_length_comes_back(spark, charset, alphabet):
    lengths = range(ff1.min_length(charset), 2 * ff1.half_length(charset) + 1)
    texts = ["".join(alphabet[(i * k + k // 3) % len(alphabet)] for k in range(n)) for n in lengths for i in (0, 3, 7)]
    texts += [alphabet[0] * n for n in lengths] + [alphabet[-1] * n for n in lengths]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    key = bytes(range(32))
    out = df.select("t", ff1.ff1_text(F.col("t"), key, charset).alias("x")).select("t", "x", ff1.ff1_text(F.col("x"), key, charset, inverse=True).alias("y")).collect()
    assert all(r["t"] == r["y"] and len(r["x"]) == len(r["t"]) for r in out)
    assert sum(r["x"] == r["t"] for r in out) <= 1 and len({r["x"] for r in out}) == len(set(texts))


def test_the_method_of_a_rule(spark):
    src = spark.createDataFrame([("4111-1111-1111-1111", "0612 345 678"), (None, "12345"), ("123", "1" * 37), ("0000000000000000", "é99 88-77/66")], "pan string, phone string")
    rules = [rule("pan", "fpe", "pans", method="ff1", validate_luhn=True), rule("phone", "fpe", "phones", method="ff1", tweak="calls")]
    out = mask_table(src, rules, SECRET, "t", with_errors=True)
    got = out.collect()
    assert got[1]["pan"] is None and got[2]["pan"] is None and got[1]["phone"] is None and got[2]["phone"] is None
    assert [len(r["__errors"]) for r in got] == [0, 1, 2, 0]
    assert got[0]["pan"][4::5] == "---" and got[0]["pan"] != "4111-1111-1111-1111" and got[3]["phone"].startswith("é") and got[3]["phone"][6] == "-"
    assert out.where("pan IS NOT NULL").select(checksums.VALIDATORS["luhn"](F.translate("pan", "-", "")).alias("ok")).distinct().collect() == [(True,)]
    back = unmask_fpe(out.select("pan", "phone"), rules, SECRET, "t").collect()
    assert back[0]["pan"] == "4111-1111-1111-1111" and [r["phone"] for r in back] == ["0612 345 678", None, None, "é99 88-77/66"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    other = mask_table(src, [rule("pan", "fpe", "pans", validate_luhn=True), *keep("phone")], SECRET, "t").first()
    assert other["pan"] != got[0]["pan"]
    for bad in (dict(method="ff3"), dict(method="ff1", checksum="luhn")):
        with pytest.raises(InvalidRule):
            mask_table(src, [rule("pan", "fpe", "pans", **bad), *keep("phone")], SECRET, "t")
