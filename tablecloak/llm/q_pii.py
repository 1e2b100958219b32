from . import pii as P
from .registry import query, table


@query("op4_weak_supervision_pii")
def op4(spark, sf_dir):
    return P.report(table(spark, sf_dir, "documents"))
