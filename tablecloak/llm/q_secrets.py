from . import secrets as S
from .registry import query, table


@query("op1_random_forest_secrets")
def op1(spark, sf_dir):
    return S.scan(table(spark, sf_dir, "documents"), path_col="source")
