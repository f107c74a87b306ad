"""op11: alignment of two tokenizers over all documents."""

import public_tokenizers

from .align import align
from .common import read_table
from .registry import query


@query("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    return align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
