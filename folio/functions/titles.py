"""Title normalisation as Column expressions.

Search and autocomplete match on a normalised title while results show the
original one. All rules are built-in string/array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed set of documentation entry types.
DOC_TYPES = ["behaviour", "callback", "exception", "extras", "function", "macro",
             "macrocallback", "module", "opaque", "protocol", "task", "type"]
# Types whose index title is the text after the last dot
# (unless the title carries a " - " suffix).
CODE_TYPES = ["function", "callback", "macro", "macrocallback", "opaque", "type"]
# Types whose index title drops the last " - " part.
PAGE_TYPES = ["behaviour", "exception", "extras", "module", "protocol"]
# Code types taken whole into the autocomplete corpus when the
# title has no space.
AUTOCOMPLETE_CODE_TYPES = ["behaviour", "callback", "exception", "function", "macro",
                           "macrocallback", "opaque", "type"]
AUTOCOMPLETE_PAGE_TYPES = ["extras", "module", "protocol"]

SEPARATOR = " - "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def extract_function(title: Column) -> Column:
    """B1: text after the last '.'."""
    return F.element_at(F.split(title, "[.]", -1), -1)


def extras_title(title: Column, glue: str = "") -> Column:
    """B2: drop the last ' - ' part; remaining parts are glued with ``glue``."""
    parts = F.split(title, SEPARATOR, -1)
    head = F.slice(parts, 1, F.size(parts) - 1)
    return F.when(F.size(parts) == 1, title).otherwise(F.array_join(head, glue))


def index_title(type_: Column, title: Column, glue: str = "") -> Column:
    """The title stored in the search/autocomplete index.

    Unknown types give null (the caller quarantines them).
    """
    return (
        F.when(type_.isin(CODE_TYPES),
               F.when(title.contains(SEPARATOR), extras_title(title, glue))
               .otherwise(extract_function(title)))
        .when(type_.isin(PAGE_TYPES), extras_title(title, glue))
        .when(type_ == "task", title)
    )


def underscore(part: Column) -> Column:
    """CamelCase -> snake_case for one dot-free name part (ASCII case only).

    An upper-case letter gets a leading '_' when it is not the first character
    and is followed by a character that is not upper-case, a digit, '.' or '_';
    or else when the character before it is neither upper-case nor '_'.
    """
    first = F.substring(part, 1, 1)
    rest = F.regexp_replace(F.substring(part, 2, 1 << 30), r"([A-Z])([^A-Z0-9._])", "_$1$2")
    step1 = F.concat(first, rest)
    step2 = F.regexp_replace(step1, r"([^A-Z_])([A-Z])", "$1_$2")
    return F.translate(step2, UPPER, LOWER)


def task_title(title: Column, glue: str = "") -> Column:
    """``Mix.Tasks.Phx.GenAuth`` -> ``phx gen_auth``; ``mix phx.gen`` -> ``mix phx gen``.

    Forms the rule does not accept give null.
    """
    parts = F.transform(F.split(title, "[.]", -1), underscore)
    mix_form = F.when(
        (F.get(parts, 0) == "mix") & (F.get(parts, 1) == "tasks"),
        F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), " "),
    )
    shell_form = F.when(F.size(F.split(title, " ", -1)) == 2, F.replace(title, F.lit("."), F.lit(" ")))
    return (
        F.when(title.contains(SEPARATOR), extras_title(title, glue))
        .when(title.startswith("Mix."), mix_form)
        .when(title.startswith("mix "), shell_form)
    )


def type_boost(type_: Column, title: Column) -> Column:
    """boost from the entry type and the original title."""
    spaced = title.contains(" ")
    return (
        F.when(type_ == "module", F.when(spaced, 0.1).otherwise(0.2))
        .when(type_.isin("function", "callback", "macro"), F.when(spaced, 0.1).otherwise(0.3))
        .when(type_ == "task", 0.1)
        .otherwise(0.0)
        .cast("double")
    )
