"""Text normalisation for search, and names of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters that lose their accents, and the white space that separates words.
ACCENTED, PLAIN = "áàäâéèëêíìïîóòöôúùüûñÁÀÄÂÉÈËÊÍÌÏÎÓÒÖÔÚÙÜÛÑ", "aaaaeeeeiiiioooouuuun" * 2
SPACES = " \t\n\r\f\u000b\u00a0"


def normalize(c: Column) -> Column:
    """Lower case without accents, letters a-z and digits only, single blanks; other signs go without splitting words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = F.translate(c, ACCENTED + upper, PLAIN + lower)
    kept = F.regexp_replace(folded, r"[^a-z0-9 \t\n\r\f\x0B\u00A0]", "")
    return F.trim(F.regexp_replace(kept, r"[ \t\n\r\f\x0B\u00A0]+", " "))


def normalize_value(text: str) -> str:
    folded = text.translate(str.maketrans(ACCENTED, PLAIN)).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.sub(f"[{SPACES}]+", " ", re.sub(f"[^a-z0-9{SPACES}]", "", folded)).strip(" ")


def status_group(status: Column | None) -> Column:
    return F.lit(0) if status is None else F.when(F.coalesce(status, F.lit(0)) == 0, F.lit(0)).otherwise(F.lit(1))


def bucket_name(partition: int, group: int) -> str:
    return f"p{abs(partition)}_s{group}"


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()
