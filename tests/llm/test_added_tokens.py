import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sondage.llm.packing import encoder, token_pieces

TEXTS = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "caf\xe9 <|endoftext|> \x85", "€ <|endoftext|> 漢",
         "<|endoftext |> <|endoftext|", "plain text", "€ plain"]


def test_ids_are_those_of_the_vocabulary_file(spark):
    vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    reference = Tokenizer.from_file(vocabulary)
    want = [reference.encode(t, add_special_tokens=False).ids for t in TEXTS]
    ids = encoder(vocabulary, ranks)
    assert [ids(t) for t in TEXTS] == want and want[0] == [505, 220, 50256, 734]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in token_pieces(docs).collect()}
    assert got == {k: (len(w) + 1, zlib.crc32(np.array([*w, 2], "<u4").tobytes())) for k, w in enumerate(want)}
