"""The semantic role of each column, from a few fused passes."""

from __future__ import annotations

import re
from collections.abc import Hashable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import parsing as P
from ..plans import order
from ..plans.fusion import AggFusion

# Names that suggest an identifier, and words that make a column a truth value.
ID_NAMES = re.compile(
    r"^(id|.*_id|id_.*|codigo|código|cod|cod_.*|key|uuid|guid|folio|nit|cedula|"
    r"cédula|documento|dni|rut|placa|serial|ticket|order_?id|customer_?id)$",
    re.IGNORECASE,
)
BOOL_WORDS = ["true", "false", "si", "sí", "no", "yes", "0", "1", "0.0", "1.0", "y", "n", "t", "f", "verdadero", "falso"]
DATE_SHARE, NUMBER_SHARE, LETTER_SHARE = 0.80, 0.85, 0.15
ID_SHARE, ID_SHARE_UNNAMED, ID_LEAST = 0.85, 0.92, 40
CATEGORY_MOST, INTEGER_CATEGORY_MOST = 50, 15
PROBE = 500  # first values that the letter test looks at


@dataclass(frozen=True)
class Role:
    name: str
    role: str
    distinct: int
    rows: int
    convertible_to: str | None = None


def infer_roles(df: DataFrame, approx: bool = False) -> dict[str, Role]:
    """The role of each column, see ``roles_with``."""
    return roles_with(df, {}, approx)[0]


def roles_with(df: DataFrame, also: dict[Hashable, Column], approx: bool = False) -> tuple[dict[str, Role], dict[Hashable, object]]:
    """Roles of all columns, and the values of the aggregates ``also``, which share the first pass.

    constante, fecha, booleana, numerica, categorica, id or texto for each column; first rule that fits.

    Distinct values are counted in one pass (by hash, or within 1 % with ``approx``); others test what the values look like
    and how much of the undecided text columns parses as dates and numbers. Nested columns are texto.
    """
    columns = N.data_columns(df)
    first = AggFusion(df)
    first.want("n", F.count("*"))
    for key, aggregate in also.items():
        first.want(("also", key), aggregate)
    whole = {c: N.q(c) if not N.is_nested(df, c) else F.to_json(F.struct(N.q(c))) for c in columns}
    for c in columns:
        if approx:
            first.want((c, "distinct"), F.approx_count_distinct(whole[c], 0.01))
    facts = first.run()
    if not approx:
        facts |= {(c, "distinct"): k for c, k in order.distinct_counts(df, whole).items()}
    n = max(facts["n"], 1)

    undecided = [c for c in columns if N.is_text(df, c) and facts[c, "distinct"] > 1]
    second = AggFusion(df)
    for c in columns:
        if facts[c, "distinct"] == 2 and not N.is_bool(df, c) and not N.is_datetime(df, c) and not N.is_nested(df, c):
            second.want((c, "odd"), F.count_if(~F.lower(P.stripped(N.q(c).cast("string"))).isin(BOOL_WORDS)))
    for c in undecided:
        col = N.q(c)
        second.want((c, "some"), F.count(col))
        second.want((c, "dates"), F.count(P.parse_datetime(col)))
        second.want((c, "letters"), F.count_if(P.has_letters(col)))
    parsed = second.run() if second.wanted else {}
    third = AggFusion(df)
    for c in undecided:  # columns of words needn't be read as numbers
        if parsed[c, "letters"] / max(parsed[c, "some"], 1) <= LETTER_SHARE:
            third.want((c, "numbers"), F.count(P.parse_number(N.q(c))))
    parsed |= third.run() if third.wanted else {}

    out = {}
    for c in columns:
        k = facts[c, "distinct"]
        role, becomes = "texto", None
        if k <= 1:
            role = "constante"
        elif N.is_datetime(df, c):
            role = "fecha"
        elif N.is_nested(df, c):
            role = "texto"
        elif k <= 2 and (N.is_bool(df, c) or parsed[c, "odd"] == 0):
            role = "booleana"
        elif N.is_numeric(df, c):
            small = N.is_integer(df, c) and k <= INTEGER_CATEGORY_MOST
            role, becomes = ("categorica", "numerica") if small else ("numerica", None)
        else:
            some = max(parsed[c, "some"], 1)
            numeric = parsed[c, "letters"] / some <= LETTER_SHARE and parsed[c, "numbers"] / some >= NUMBER_SHARE
            if ID_NAMES.match(c) and k / n > ID_SHARE or k / n > ID_SHARE_UNNAMED and k > ID_LEAST:
                role = "id"
            elif parsed[c, "dates"] / some >= DATE_SHARE:
                role, becomes = "texto", "fecha"
            elif numeric:
                role, becomes = "texto", "numerica"
            elif k <= CATEGORY_MOST:
                role = "categorica"
        out[c] = Role(c, role, k, facts["n"], becomes)
    return out, {key: facts["also", key] for key in also}


def by_role(roles: dict[str, Role], *wanted: str) -> list[str]:
    return [c for c, r in roles.items() if r.role in wanted]


def roles_table(df: DataFrame, approx: bool = False) -> DataFrame:
    rows = [(r.name, r.role, r.distinct, r.convertible_to) for r in infer_roles(df, approx).values()]
    return df.sparkSession.createDataFrame(rows, "variable string, rol string, unicos long, convertible_a string")


def suggestion(role: Role) -> str:
    """What to do with a column, in words."""
    if role.convertible_to:
        return f"Convertir a {role.convertible_to}"
    return {
        "constante": "Eliminar: no aporta información",
        "id": "Excluir del modelo: identifica filas",
        "texto": "Tratar como texto libre o excluir",
        "fecha": "Extraer partes de la fecha",
    }.get(role.role, "Usar tal cual")
