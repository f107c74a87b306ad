"""op9: all documents packed into sequences of 2048 tokens."""

import public_tokenizers

from .common import read_table
from .packing import pack_documents
from .registry import query


@query("op9_packing")
def op9_packing(spark, sf_dir):
    out = pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, 1)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
