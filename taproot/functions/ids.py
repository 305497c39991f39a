"""Deterministic identifiers, as expressions that stay in the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from taproot.functions.text import SPACE, strip


def document_name(path: Column) -> Column:
    """Base name without its last extension; a name that is all extension stays whole."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)
    return F.when(stem == "", base).otherwise(stem)


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 name-based id of ``name``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.substr(variant, nibble + 1, F.lit(1)), F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def chunk_id(namespace: uuid.UUID, document_id: Column, variant: Column, index: Column) -> Column:
    return uuid5(namespace, F.concat_ws(":", document_id, variant, index.cast("string")))


def snippet_id(document_id: Column, local_ref: Column) -> Column:
    """Global id of a snippet."""
    return F.sha2(F.concat_ws(":", document_id, local_ref), 256)


def edge_uid(document: Column, parent_ref: Column, child_ref: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", document, parent_ref, child_ref), 256), 1, 16)


def clip(text: Column, longest: int = 1200, keep_lines: bool = False) -> Column:
    """A text for a reader: on one line, or with its lines but single spaces, cut after ``longest`` characters."""
    flat = strip(F.regexp_replace(text, "[ \\t]+", " ")) if keep_lines else strip(F.regexp_replace(text, f"[{SPACE}]+", " "))
    return F.when(F.length(flat) > longest, F.concat(F.substring(flat, 1, longest), F.lit(" […]"))).otherwise(flat)
