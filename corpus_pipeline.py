"""From raw documents to a training mixture, in five stages.

Each stage takes the documents its predecessor kept, as (spark, docs, sf_dir), and
returns a DataFrame; all but the last return the columns of documents.  Between stages
the rows are written as Parquet and read again, so a lost executor never repeats more
than one stage.
"""

from __future__ import annotations

from tidewatch.llm import decontaminate, language, minhash, mixing, pii
from tidewatch.llm.common import staged, table


def identify_language(spark, docs, sf_dir):
    """Documents without letters, or far from every language known, go."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays."""
    return minhash.deduplicate(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark, docs, sf_dir):
    """Personal data is replaced by its kind; every document stays."""
    return pii.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """One row for every visit of a document in the mixture."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixture", mix_sources),
]

#: language ID, redaction and min-max hashing have no SQL twin; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
