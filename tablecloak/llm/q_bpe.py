import public_tokenizers

from . import bpe as B
from .registry import query, table


@query("op12_bitmap_queue_bpe")
def op12(spark, sf_dir):
    ranks = B.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return B.report(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
