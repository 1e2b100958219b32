import public_tokenizers

from . import alignment as A
from .registry import query, table


@query("op13_perfect_hash_alignment")
def op13(spark, sf_dir):
    both = A.Tokenizers.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return A.report(table(spark, sf_dir, "documents"), both)
