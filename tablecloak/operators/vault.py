"""Token vault: (namespace, value) <-> token, a Parquet table partitioned by namespace.

The vault is authoritative: a stored pair is reused even after a key change. Values are NFC-normalised first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRule, VaultExists, VaultMiss
from ..keys import check_secret, hmac_hex, subkey
from ..session import materialize
from .joins import lookup_join

VAULT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("ns", "value", "token")])


def _make_nfc():
    # a local function travels to the workers by value, so they need no copy of this package
    def nfc(s: pd.Series) -> pd.Series:
        import unicodedata
        return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v), na_action="ignore")

    return F.pandas_udf(nfc, T.StringType())


nfc = _make_nfc()


def normalized(df: DataFrame, columns: Sequence[str], name=lambda c: c) -> DataFrame:
    """NFC text of the columns. Only rows with a character outside ASCII go through Python; text is ASCII exactly
    when it has as many bytes as characters."""
    text = {c: F.col(c).cast("string") for c in columns}
    plain = reduce(lambda a, b: a & b, [F.coalesce(F.octet_length(x) == F.length(x), F.lit(True)) for x in text.values()])
    quick = df.where(plain).withColumns({name(c): x for c, x in text.items()})
    return quick.unionByName(df.where(~plain).withColumns({name(c): nfc(x) for c, x in text.items()}))


def empty_vault(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VAULT_SCHEMA)


def token_of(secret: bytes, ns: str, value: Column) -> Column:
    return F.concat(F.lit("tok_"), F.substring(hmac_hex(subkey(check_secret(secret), "tokenize", ns), value), 1, 32))


def new_entries(values: DataFrame, vault: DataFrame, ns: str, secret: bytes) -> DataFrame:
    """Vault rows for the distinct values not stored yet. ``values`` has one column, ``value``."""
    known = vault.where(F.col("ns") == ns).select("value")
    fresh = values.where("value is not null").distinct().join(known, "value", "left_anti")
    return fresh.select(F.lit(ns).alias("ns"), "value", token_of(secret, ns, F.col("value")).alias("token"))


def tokenize(df: DataFrame, columns: Sequence[str], ns: str, secret: bytes, vault: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masked frame and grown vault. Only distinct values are normalised, and each is looked up once; the pairs of written form
    and token are cut, so that neither the vault nor the values are worked out again for every column."""
    cells = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("raw"))
    forms = materialize(normalized(cells.where("raw IS NOT NULL").distinct(), ["raw"], lambda _: "value"), "forms")
    grown = materialize(vault.unionByName(new_entries(forms.select("value"), vault, ns, secret)), "vault")
    pairs = materialize(forms.join(grown.where(F.col("ns") == ns).select("value", "token"), "value").select("raw", "token"), "tokens")
    out = df.withColumns({f"__n_{c}": F.col(c).cast("string") for c in columns})
    for c in columns:
        out = lookup_join(out, pairs.select(F.col("raw").alias(f"__n_{c}"), F.col("token").alias(f"__t_{c}")), [f"__n_{c}"])
    return out.select(*[F.col(f"__t_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]), grown


def detokenize(df: DataFrame, columns: Sequence[str], ns: str, vault: DataFrame, check: bool = True) -> DataFrame:
    """Reverse by (namespace, token). Any miss fails the whole job before anything is written; null stays null."""
    pairs = vault.where(F.col("ns") == ns).select("token", "value")
    out = df
    for c in columns:
        small = pairs.select(F.col("token").alias(c), F.col("value").alias(f"__v_{c}"))
        out = lookup_join(out, small, [c])
    if check:
        # looked up once, for the check and for the result
        out = materialize(out, "reversed")
        miss = out.agg(*[F.count_if(F.col(c).isNotNull() & F.col(f"__v_{c}").isNull()).alias(c) for c in columns]).first()
        bad = [c for c in columns if miss[c]]
        if bad:
            raise VaultMiss(f"tokens without a vault entry in {', '.join(bad)}")
    return out.select(*[F.col(f"__v_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def save_vault(vault: DataFrame, path: str) -> None:
    """Create-only."""
    try:
        # files of an even size, as many as the vault needs
        vault.hint("rebalance", "ns").write.mode("errorifexists").partitionBy("ns").parquet(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            raise VaultExists("a vault is already there") from None
        raise


def load_vault(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("ns", "value", "token")


def vault_report(pairs: DataFrame) -> DataFrame:
    """Per namespace: entries that can be reversed, and masked values dropped because two sources share them.
    ``pairs`` has ns, value, token."""
    per = pairs.distinct().groupBy("ns", "token").agg(F.count("*").alias("n"))
    return per.groupBy("ns").agg(F.count_if(F.col("n") == 1).alias("entries"), F.count_if(F.col("n") > 1).alias("ambiguous"))


# ---- the encrypted source-to-masked map of a vaulted column


def _aes_key(secret: bytes) -> Column:
    return F.lit(subkey(check_secret(secret), "vault", "aes-gcm"))


def vault_write(source: DataFrame, masked: DataFrame, on: Sequence[str], columns: Sequence[str], ns: str, secret: bytes,
                path: str | None = None) -> DataFrame:
    """(ns, token, sealed) for the masked columns: the masked value in clear, the source value under AES-GCM. Masked values that two
    sources share are left out.

    Rows meet by the key ``on``, a null being a key like any other. A key that repeats would seal values of other rows, and a
    row of one side only could not be reversed: both are refused before anything is written.
    """
    same = F.lit(True)
    for side, frame in (("source", source), ("masked", masked)):
        if not frame.groupBy(*on).agg(F.count("*").alias("__n")).where("__n > 1").isEmpty():
            raise InvalidRule(f"the key does not tell the rows of the {side} table apart")
    s = source.select(F.struct(*on).alias("__ks"), *[F.col(c).cast("string").alias(f"__s_{c}") for c in columns])
    m = masked.select(F.struct(*on).alias("__km"), *[F.col(c).cast("string").alias(f"__m_{c}") for c in columns])
    for k in on:
        same = same & F.col("__ks")[k].eqNullSafe(F.col("__km")[k])
    both = materialize(s.join(m, same, "full_outer"), "vault_pairs")
    lost = both.where("__ks IS NULL OR __km IS NULL").count()
    if lost:
        raise VaultMiss(f"{lost} rows are in one of the two tables only")
    pairs = both.select(F.explode(F.array(*[F.struct(F.col(f"__m_{c}").alias("token"), F.col(f"__s_{c}").alias("value")) for c in columns])).alias("p")).select("p.*").dropna()
    sealed = seal(pairs.withColumn("ns", F.lit(ns)), secret)
    if path:
        save_sealed(sealed, path)
    return sealed


def seal(pairs: DataFrame, secret: bytes) -> DataFrame:
    """(ns, token, sealed) of (ns, token, value) pairs; a token of two sources is left out."""
    # min = max tells a one-source token without holding its sources
    one = pairs.dropna().groupBy("ns", "token").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo = hi")
    return one.select("ns", "token", F.base64(F.aes_encrypt("lo", _aes_key(secret), F.lit("GCM"))).alias("sealed"))


def save_sealed(sealed: DataFrame, path: str) -> None:
    """Create-only."""
    try:
        sealed.write.mode("errorifexists").partitionBy("ns").parquet(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            raise VaultExists("a vault is already there") from None
        raise


def vault_read(df: DataFrame, columns: Sequence[str], ns: str, secret: bytes, sealed: DataFrame) -> DataFrame:
    """Reverse what the vault can and add ``<column>_status``: vault_reversed, vault_miss or untouched (null)."""
    small = sealed.where(F.col("ns") == ns).select("token", "sealed")
    out = df
    for c in columns:
        out = lookup_join(out.withColumn("token", F.col(c).cast("string")), small, ["token"]).withColumn(
            f"__v_{c}", F.try_aes_decrypt(F.unbase64("sealed"), _aes_key(secret), F.lit("GCM")).cast("string")).drop("token", "sealed")
    status = [F.when(F.col(c).isNull(), "untouched").when(F.col(f"__v_{c}").isNull(), "vault_miss").otherwise("vault_reversed")
              .alias(f"{c}_status") for c in columns]
    return out.select(*[F.coalesce(F.col(f"__v_{c}"), F.col(c).cast("string")).alias(c) if c in columns else F.col(c) for c in df.columns],
                      *status)


