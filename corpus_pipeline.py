"""The corpus pipeline: each stage takes what its predecessor kept.

Toxicity drops what the classifier rejects, SimHash near-dedup keeps one document of each
group of similar texts (cosine of the five-word shingle sets of 0.8 or more), the one with
the smallest id; decontamination drops documents that hold a window of the benchmark, PII
replaces personal data by its kind, and encoding returns the token ids' digests.

Every row is decided by itself, whatever its id: rows without an id or with another row's
id are documents of their own, and of repeated rows near-dedup keeps one. Columns beyond
doc_id and text pass through every stage but the last, under any name; empty tables pass.
"""

from __future__ import annotations

import public_tokenizers

from tessera.llm import byte_bpe, decontaminate, pii, simhash, toxicity
from tessera.llm.common import table


def toxicity_stage(spark, docs, sf_dir):
    """Documents that score below the threshold. The labels teach as in op3."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(model)("text") < toxicity.THRESHOLD)


def simhash_stage(spark, docs, sf_dir):
    """One document of each group of similar texts."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents without any window of the benchmark."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark, docs, sf_dir):
    """Texts with personal data replaced by [KIND]; n_chars follows."""
    return pii.redacted_documents(docs)


def encoding_stage(spark, docs, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=False)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", encoding_stage),
]

#: A classifier and a fingerprint have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over documents, each written to the shared folder and read again."""
    from tessera.llm.common import Stage

    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage.write(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
