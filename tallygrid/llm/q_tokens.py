"""Query op2: token ids of all documents, written and read back."""

from tallygrid.llm.registry import query
from tallygrid.llm.shared import table, temporary_folder
from tallygrid.llm.token_tables import read_tokens, with_checksum, write_tokens


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_digests(spark, docs):
    folder = temporary_folder(spark, "tokens")
    write_tokens(docs, folder, vocabulary(), end_id=1)
    return with_checksum(read_tokens(spark, folder))


@query("op2_token_table")
def op2(spark, sf_dir):
    return token_digests(spark, table(spark, sf_dir, "documents"))
