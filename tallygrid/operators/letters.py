"""Letter bodies and prompt rows built from concept totals with column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.numbers import spanish_number
from tallygrid.operators import close_rules as rules
from tallygrid.operators.close_rules import DEFAULTS, Thresholds
from tallygrid.operators.concepts import CONCEPTS

# The sections of a letter, in their order, and the closing text.
SECTIONS = (
    "RESULTADO E IMPUESTO",
    "ALERTA FALSOS AUTÓNOMOS",
    "ARRENDAMIENTOS",
    "SUMINISTROS",
    "AMORTIZACIONES",
    "GASTOS FINANCIEROS",
    "CONCLUSIÓN DEL CIERRE CONTABLE",
    "FINAL DEL MAIL",
)
CLOSING = (
    "Para cualquier consulta, quedamos a su total disposición para concertar una cita presencial "
    "o resolver las dudas mediante una llamada telefónica o videollamada.\n"
    "Un saludo y gracias."
)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _euros(amount: Column) -> Column:
    return _text(spanish_number(amount), " €")


def _compared(key: str, name: str, years: tuple[int, int]) -> Column:
    """``<name>: <last year> en 2024, <this year> en 2025 (+x,xx%).``"""
    pct = rules.change_pct(key)
    change = F.when(pct.isNull(), "sin comparación").otherwise(
        _text(F.when(pct > 0, "+").otherwise(""), spanish_number(pct), "%")
    )
    return _text(
        f"{name}: ", _euros(rules.prev(key)), f" en {years[1]}, ",
        _euros(rules.cur(key)), f" en {years[0]} (", change, ").",
    )


def _percent(share: Column) -> Column:
    return F.coalesce(_text(spanish_number(F.round(share * 100, 2)), "%"), F.lit("sin datos"))


def _either(alert: Column, yes: str, no: str) -> Column:
    return F.when(alert, yes).otherwise(no)


def letter_body(years: tuple[int, int], t: Thresholds = DEFAULTS) -> Column:
    """The eight sections as one text; a section without findings says so."""
    compared = {c.key: _compared(c.key, c.name, years) for c in CONCEPTS}
    tax, last_tax = F.abs(rules.cur("impuesto")), F.abs(rules.prev("impuesto"))
    moves = F.when(tax > last_tax, "aumenta").when(tax < last_tax, "disminuye").otherwise("no varía")
    contents = [
        _text(
            compared["ventas"], " ", compared["gastos"], " ", compared["resultado"], " ", compared["impuesto"],
            " Margen sobre ventas: ", _percent(rules.margin()),
            "; impuesto sobre el resultado previo: ", _percent(rules.effective_rate()), ".",
            _either(
                rules.cur("ventas") < rules.TAX_LIMIT,
                " La facturación no llega a un millón de euros: tipo reducido del 23%.",
                " La facturación alcanza el millón de euros: tipo general del 25%.",
            ),
        ),
        _either(
            rules.false_self_employed(t),
            "La cuenta 6230 es alta y no hay salarios: riesgo de que los profesionales "
            "se recalifiquen como falsos autónomos.",
            "No aplica.",
        ),
        _text(
            compared["arrendamientos"],
            _either(rules.rent_alert(t), " Variación relevante: conviene revisarla.", " Estables."),
        ),
        _text(
            compared["suministros"],
            _either(
                rules.utilities_alert(t),
                " Variación relevante: puede haber gastos de los socios ajenos a la actividad.",
                " Estables.",
            ),
        ),
        _text(
            compared["amortizaciones"],
            _either(
                rules.new_assets(),
                " Aumentan: probablemente se adquirió nuevo inmovilizado.",
                " No aumentan.",
            ),
        ),
        _text(
            compared["gastos_financieros"],
            _either(
                rules.financing_alert(t),
                " Aumento significativo: mayor financiación ajena y más riesgo.",
                " Sin aumento significativo.",
            ),
        ),
        _text(
            "El impuesto ", moves, "; la partida que más cambia es: ", rules.main_driver(), ".",
        ),
        F.lit(CLOSING),
    ]
    return F.concat_ws("\n\n", *[_text(f"[{title}]\n", body) for title, body in zip(SECTIONS, contents)])


def letter_bodies(
    totals: DataFrame, years: tuple[int, int], t: Thresholds = DEFAULTS, by: Sequence[str] = ("client",)
) -> DataFrame:
    return totals.select(*by, letter_body(years, t).alias("body"))


def summary_json(years: tuple[int, int]) -> Column:
    """The summary as JSON text: concept -> year -> amount with two decimals."""

    def by_year(key: str) -> Column:
        return F.struct(*[
            F.col(f"{key}_{end}").cast("decimal(28,2)").alias(str(year))
            for end, year in zip(("cur", "prev"), years)
        ])

    return F.to_json(F.struct(*[by_year(c.key).alias(c.name) for c in CONCEPTS]))


def prompt_rows(totals: DataFrame, years: tuple[int, int], by: Sequence[str] = ("client",)) -> DataFrame:
    """One request text per client, ready for any text generator: task, data, sections."""
    task = (
        f"Redacta como asesor fiscal el informe de cierre {years[0]} frente a {years[1]}, en tono profesional "
        "y directo, a partir de estos datos:\n"
    )
    sections = ", ".join(f"[{s}]" for s in SECTIONS)
    layout = f"\nUsa estas secciones en este orden, sin omitir ninguna: {sections}"
    return totals.select(*by, _text(task, summary_json(years), layout).alias("prompt"))
