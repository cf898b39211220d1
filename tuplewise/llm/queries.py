"""Queries over the corpus tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op5_latent_semantic
from .fingerprints import op7_canonical_digest
from .html_extraction import op1_equivalence_classes
from .language_id import op8_subword_embeddings
from .licenses import op6_license_digests
from .licenses import oracle as op6_sql
from .near_dedup import op9_hyperminhash
from .packing import op3_karmarkar_karp
from .quality import op4_ftrl
from .sharding import op2_virtual_slots
from .suffix_dedup import op10_bwt_expansion


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_equivalence_classes": op1_equivalence_classes,
        "op2_virtual_slots": op2_virtual_slots,
        "op3_karmarkar_karp": op3_karmarkar_karp,
        "op4_ftrl": op4_ftrl,
        "op5_latent_semantic": op5_latent_semantic,
        "op6_license_digests": op6_license_digests,
        "op8_subword_embeddings": op8_subword_embeddings,
        "op7_canonical_digest": op7_canonical_digest,
        "op9_hyperminhash": op9_hyperminhash,
        "op10_bwt_expansion": op10_bwt_expansion,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_license_digests": op6_sql()}
