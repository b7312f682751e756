"""Registered ledger queries, each with the SQL it must agree with."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.numbers import spanish_number
from tallygrid.operators import close_rules as rules
from tallygrid.operators.concepts import (
    CONCEPTS,
    EXTENDED,
    account_totals,
    concept_summary,
    concepts_from_json,
    concepts_named,
    pattern_total,
    summary_by_label,
    to_summary,
    year_totals,
)
from tallygrid.operators.letters import CLOSING, SECTIONS, letter_bodies, prompt_rows
from tallygrid.plans.close import close_folder, folder_totals
from tallygrid.plans.tables import (
    DAMAGED_EVERY,
    YEARS,
    folder_client,
    ledger,
    ledger_sql,
    table,
    write_client_files,
    write_damaged_files,
    write_ledger_files,
    write_mixed_files,
)
from tallygrid.session import scratch_dir
from tallygrid.sources.files import list_in_few_tasks
from tallygrid.sources.ledgers import (
    amount_quality,
    land_bucketed,
    read_landed,
    read_ledgers,
    read_mixed_ledgers,
    to_long,
    write_quarantine,
)
from tallygrid.sources.letters import (
    GREETING,
    read_packed_letters,
    wrap_letter,
    write_letters,
    write_packed_letters,
)
from tallygrid.streaming.arrivals import arrived_totals, close_arrivals, ledger_stream

CUR, PREV = YEARS
LIMITS = rules.Thresholds(
    min_professionals=500_000, rent_pct=25, utilities_pct=25, amortization_pct=25, financing_pct=50
)


def totals(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return year_totals(ledger(spark, sf_dir), YEARS, concepts=concepts_named(*keys) if keys else CONCEPTS)


def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concept_summary(ledger(spark, sf_dir), YEARS)


def pattern_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pattern_total(ledger(spark, sf_dir), "640|642", YEARS)
    return found.select("client", *[F.col(c).cast("double").alias(c) for c in ("cur", "prev")])


def anchored_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concept_summary(ledger(spark, sf_dir), YEARS, anchored=True)


def pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_by_label(ledger(spark, sf_dir), YEARS, concepts=concepts_from_json(PATTERN_TABLE))


def pattern_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of patterns too long to try each on every label."""
    return summary_by_label(ledger(spark, sf_dir), YEARS, concepts=concepts_from_json(LONG_TABLE))


def landed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger landed by client and added up without a shuffle."""
    path, name = scratch_dir(spark, "landed"), f"landed_{uuid.uuid4().hex}"
    land_bucketed(ledger(spark, sf_dir), name, path, 16)
    return concept_summary(read_landed(spark, name, path), YEARS)


def damaged_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers of which some lines have a field too many: their number and the sums of the others."""
    path = write_damaged_files(spark, sf_dir)
    counts = write_quarantine(spark, path, scratch_dir(spark, "quarantine"), folder_client())
    lost = counts.groupBy("client").agg(F.sum("n").alias("damaged"))
    sums = to_long(read_ledgers(spark, path, folder_client(), damaged="leave_out")).groupBy("client").agg(
        (F.count("*") / 2).cast("long").alias("kept"), F.sum("amount").cast("double").alias("amount")
    )
    return sums.join(lost, "client", "full").select(
        "client", F.coalesce("damaged", F.lit(0)).alias("damaged"), F.coalesce("kept", F.lit(0)).alias("kept"), "amount"
    )


def packed_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of all clients in a few files, read back from them."""
    path = scratch_dir(spark, "packed-letters")
    write_packed_letters(letter_bodies(totals(spark, sf_dir), YEARS, LIMITS), path, packs=8)
    return read_packed_letters(spark, path).select(F.col("client").cast("bigint").alias("client"), "letter")


def account_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return account_totals(ledger(spark, sf_dir), YEARS, digits=3)


def extended_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concept_summary(ledger(spark, sf_dir), YEARS, concepts=EXTENDED)


def yoy_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.with_changes(totals(spark, sf_dir), YEARS)


def tax_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark, sf_dir, "ventas").select(
        "client", rules.cur("ventas").alias("ventas"), rules.tax_rate().alias("rate")
    )


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark, sf_dir, "ventas", "resultado", "impuesto").select(
        "client",
        F.round(rules.margin(), 6).alias("margin"),
        F.round(rules.effective_rate(), 6).alias("effective_rate"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.with_alerts(totals(spark, sf_dir, *rules.ALERT_KEYS), LIMITS)


def main_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark, sf_dir, *rules.DRIVERS).select("client", rules.main_driver().alias("driver"))


def screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark, sf_dir, *rules.ALERT_KEYS).select("client", rules.screening(LIMITS).alias("screening"))


def letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letter_bodies(totals(spark, sf_dir), YEARS, LIMITS).select(
        "client", wrap_letter("body").alias("letter")
    )


def prompt_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_rows(totals(spark, sf_dir), YEARS)


def letter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "letters")
    branches = ledger(spark, sf_dir).withColumn("client", F.col("branch"))
    write_letters(letter_bodies(year_totals(branches, YEARS), YEARS, LIMITS), path)
    return _letters_in(spark, path)


def _letters_in(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    list_in_few_tasks(spark)
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("client").cast(kind).alias("client"), F.rtrim("value", F.lit("\n")).alias("letter"))


def folder_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one file per client to one letter per client."""
    out = scratch_dir(spark, "folder-letters")
    close_folder(spark, f"{write_client_files(spark, sf_dir)}/*.csv", out, YEARS, LIMITS)
    return _letters_in(spark, out, "bigint")


def folder_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_ledger_files(spark, sf_dir)
    return to_summary(folder_totals(spark, path, YEARS, folder_client()), YEARS)


def folder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_ledger_files(spark, sf_dir)
    return _line_counts(to_long(read_ledgers(spark, path, folder_client())))


def mixed_folder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_mixed_files(spark, sf_dir)
    return _line_counts(read_mixed_ledgers(spark, f"{path}/*", folder_client()))


def amount_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of amounts of which some are no numbers and some in English layout."""
    price = F.col("l_extendedprice")
    text = (
        F.when(F.col("l_discount") == 0, "pendiente")
        .when(F.col("l_tax") >= 0.07, F.format_number(price, 2))
        .otherwise(spanish_number(price))
    )
    odd = F.year("l_shipdate") % 2
    wide = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("client"),
        F.when(odd == 1, text).alias(f"AÑO {CUR}"),
        F.when(odd == 0, text).alias(f"AÑO {PREV}"),
    )
    return amount_quality(wide)


def _line_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("client", "label", "year").agg(
        F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount")
    )


def arrivals_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = scratch_dir(spark, "arrivals"), scratch_dir(spark, "arrivals-progress")
    lines = ledger_stream(spark, f"{write_ledger_files(spark, sf_dir)}/*", YEARS, folder_client())
    close_arrivals(lines, out, checkpoint).awaitTermination()
    return to_summary(arrived_totals(spark, out), YEARS)


def arrivals_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of branches whose files arrive in several micro-batches."""
    out, checkpoint = scratch_dir(spark, "arrivals"), scratch_dir(spark, "arrivals-progress")
    letters = scratch_dir(spark, "arrivals-letters")
    path = write_ledger_files(spark, sf_dir)
    lines = ledger_stream(spark, f"{path}/*", YEARS, folder_client(), files_per_batch=4)
    close_arrivals(lines, out, checkpoint, letters, YEARS, LIMITS).awaitTermination()
    return _letters_in(spark, letters)


QUERIES = {
    "ledger_summary": ledger_summary,
    "pattern_sums": pattern_sums,
    "anchored_summary": anchored_summary,
    "pattern_table": pattern_table,
    "yoy_change": yoy_change,
    "tax_tier": tax_tier,
    "margins": margins,
    "alerts": alerts,
    "main_driver": main_driver,
    "screening": screening,
    "letter": letter,
    "prompt_batch": prompt_batch,
    "letter_files": letter_files,
    "folder_close": folder_close,
    "folder_lines": folder_lines,
    "mixed_folder_lines": mixed_folder_lines,
    "folder_letters": folder_letters,
    "arrivals_close": arrivals_close,
    "arrivals_letters": arrivals_letters,
    "account_sums": account_sums,
    "extended_summary": extended_summary,
    "amount_texts": amount_texts,
    "pattern_index": pattern_index,
    "landed_summary": landed_summary,
    "damaged_ledgers": damaged_ledgers,
    "packed_letters": packed_letters,
}

# A long list, as a configuration file holds it: the ten concepts and single accounts.
PATTERNS = {c.name: c.pattern for c in CONCEPTS} | {f"Grupo {code}": f"^{code}" for code in range(620, 640)}
PATTERN_TABLE = json.dumps(PATTERNS)
# One too long to try each pattern on every label: account ranges, endings and words of labels.
LONG_PATTERNS = (
    PATTERNS
    | {f"Cuenta {code}": rf"^\s*{code}" for code in range(6000, 6500)}
    | {f"Final {code}": rf"{code}\s+\S" for code in range(210, 300)}
    | {"Servicios": "servicios (profesionales|de)|otros serv", "Sueldos": r"\bsueldos?$", "Cifra": r"^\d+\. .* la cifra"}
)
LONG_TABLE = json.dumps(LONG_PATTERNS)


def _totals_sql(concepts, by: str = "client", anchored: bool = False) -> str:
    """SQL of the totals: ``<key>_cur`` and ``<key>_prev`` as DOUBLE."""
    sums = []
    for key, _, pattern in concepts:
        if anchored:
            pattern = rf"^\s*(?:{pattern})"
        for year, end in ((CUR, "cur"), (PREV, "prev")):
            sums.append(
                f"CAST(coalesce(sum(amount) FILTER (WHERE year = {year}"
                f" AND regexp_matches(label, '{pattern}', 'i')), 0) AS DOUBLE) AS {key}_{end}"
            )
    return f"SELECT {by} AS client, {', '.join(sums)} FROM ({ledger_sql()}) GROUP BY ALL"


def _summary_sql(concepts, by: str = "client", anchored: bool = False) -> str:
    rows = " UNION ALL ".join(
        f"SELECT client, '{name}' AS concept, {key}_cur AS y{CUR}, {key}_prev AS y{PREV} FROM t"
        for key, name, _ in concepts
    )
    return f"WITH t AS ({_totals_sql(concepts, by, anchored)}) {rows}"


def _pct_sql(key: str) -> str:
    now, before = f"{key}_cur", f"{key}_prev"
    delta = f"{now} - {before}" if key == "resultado" else f"abs({now}) - abs({before})"
    # + 0 turns a rounded -0.0 into 0.0, which is what Spark's round gives.
    return f"(round(({delta}) / nullif(abs({before}), 0) * 100, 2) + 0)"


def _moved_sql(key: str, limit: float) -> str:
    return f"coalesce(abs({_pct_sql(key)}) > {limit}, false)"


ALERTS_SQL = {
    "false_self_employed": f"(abs(profesionales_cur) > {LIMITS.min_professionals} AND salarios_cur = 0)",
    "rent_alert": _moved_sql("arrendamientos", LIMITS.rent_pct),
    "utilities_alert": _moved_sql("suministros", LIMITS.utilities_pct),
    "new_assets": "(abs(amortizaciones_cur) > abs(amortizaciones_prev))",
    "financing_alert": (
        f"(coalesce({_pct_sql('gastos_financieros')} > {LIMITS.financing_pct}, false)"
        " OR (gastos_financieros_prev = 0 AND gastos_financieros_cur <> 0))"
    ),
}
MARGIN_SQL = "(resultado_cur / nullif(ventas_cur, 0))"
EFFECTIVE_SQL = "(abs(impuesto_cur) / nullif(resultado_cur + abs(impuesto_cur), 0))"
DRIVER_SQL = "list_max([{}]).concept".format(
    ", ".join(
        f"{{'delta': abs({k}_cur - {k}_prev), 'concept': '{name}'}}"
        for k, name, _ in CONCEPTS
        if k in rules.DRIVERS
    )
)


def _number_sql(value: str) -> str:
    return f"translate(format('{{:,.2f}}', {value}), ',.', '.,')"


def _compared_sql(key: str, name: str) -> str:
    pct = _pct_sql(key)
    return (
        f"'{name}: ' || {_number_sql(key + '_prev')} || ' € en {PREV}, ' || {_number_sql(key + '_cur')}"
        f" || ' € en {CUR} (' || CASE WHEN {pct} IS NULL THEN 'sin comparación'"
        f" ELSE CASE WHEN {pct} > 0 THEN '+' ELSE '' END || {_number_sql(pct)} || '%' END || ').'"
    )


def _letter_sql(by: str = "client") -> str:
    compared = {key: _compared_sql(key, name) for key, name, _ in CONCEPTS}

    def either(alert: str, yes: str, no: str) -> str:
        return f"CASE WHEN {alert} THEN '{yes}' ELSE '{no}' END"

    def percent(share: str) -> str:
        return f"coalesce({_number_sql(f'round({share} * 100, 2) + 0')} || '%', 'sin datos')"

    contents = [
        f"{compared['ventas']} || ' ' || {compared['gastos']} || ' ' || {compared['resultado']} || ' ' || "
        + f"{compared['impuesto']} || ' Margen sobre ventas: ' || {percent(MARGIN_SQL)} || "
        + f"'; impuesto sobre el resultado previo: ' || {percent(EFFECTIVE_SQL)} || '.' || "
        + either(
            "ventas_cur < 1000000",
            " La facturación no llega a un millón de euros: tipo reducido del 23%.",
            " La facturación alcanza el millón de euros: tipo general del 25%.",
        ),
        either(
            ALERTS_SQL["false_self_employed"],
            "La cuenta 6230 es alta y no hay salarios: riesgo de que los profesionales "
            "se recalifiquen como falsos autónomos.",
            "No aplica.",
        ),
        f"{compared['arrendamientos']} || "
        + either(ALERTS_SQL["rent_alert"], " Variación relevante: conviene revisarla.", " Estables."),
        f"{compared['suministros']} || "
        + either(
            ALERTS_SQL["utilities_alert"],
            " Variación relevante: puede haber gastos de los socios ajenos a la actividad.",
            " Estables.",
        ),
        f"{compared['amortizaciones']} || "
        + either(
            ALERTS_SQL["new_assets"], " Aumentan: probablemente se adquirió nuevo inmovilizado.", " No aumentan."
        ),
        f"{compared['gastos_financieros']} || "
        + either(
            ALERTS_SQL["financing_alert"],
            " Aumento significativo: mayor financiación ajena y más riesgo.",
            " Sin aumento significativo.",
        ),
        "'El impuesto ' || CASE WHEN abs(impuesto_cur) > abs(impuesto_prev) THEN 'aumenta'"
        " WHEN abs(impuesto_cur) < abs(impuesto_prev) THEN 'disminuye' ELSE 'no varía' END"
        f" || '; la partida que más cambia es: ' || {DRIVER_SQL} || '.'",
        f"'{CLOSING}'",
    ]
    sections = [f"'[{title}]\n' || {body}" for title, body in zip(SECTIONS, contents)]
    return (
        f"WITH t AS ({_totals_sql(CONCEPTS, by)}) SELECT client, '{GREETING}\n\n' || "
        + " || '\n\n' || ".join(sections)
        + " AS letter FROM t"
    )


def _prompt_sql() -> str:
    def money(column: str) -> str:
        return f"printf('%.2f', {column})"

    entries = " || ',' || ".join(
        f"'\"{name}\":{{\"{CUR}\":' || {money(key + '_cur')} || ',\"{PREV}\":' || {money(key + '_prev')} || '}}'"
        for key, name, _ in CONCEPTS
    )
    sections = ", ".join(f"[{s}]" for s in SECTIONS)
    return (
        f"WITH t AS ({_totals_sql(CONCEPTS)}) SELECT client, "
        f"'Redacta como asesor fiscal el informe de cierre {CUR} frente a {PREV}, en tono profesional y directo, "
        f"a partir de estos datos:\n{{' || {entries} || '}}\n"
        f"Usa estas secciones en este orden, sin omitir ninguna: {sections}' AS prompt FROM t"
    )


def _quoted(texts) -> str:
    return ", ".join("'" + text.replace("'", "''") + "'" for text in texts)


def _from_totals(columns: str) -> str:
    return f"WITH t AS ({_totals_sql(CONCEPTS)}) SELECT client, {columns} FROM t"


def _changes_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT client, '{name}' AS concept, {key}_cur AS y{CUR}, {key}_prev AS y{PREV},"
        f" {_pct_sql(key)} AS change_pct FROM t"
        for key, name, _ in CONCEPTS
    )
    return f"WITH t AS ({_totals_sql(CONCEPTS)}) {rows}"


# Every written line holds an amount for one year and an empty cell for the other.
LINES_SQL = f"""
    WITH l AS ({ledger_sql()}), y AS (SELECT unnest([{CUR}, {PREV}]) AS year)
    SELECT l.branch AS client, l.label, y.year, count(*) AS n,
           CAST(sum(CASE WHEN l.year = y.year THEN amount ELSE 0 END) AS DOUBLE) AS amount
    FROM l, y GROUP BY ALL"""

SUMMARY_BY_BRANCH_SQL = _summary_sql(CONCEPTS, by="branch")

ORACLES = {
    "ledger_summary": _summary_sql(CONCEPTS),
    "pattern_sums": _totals_sql([("c", "c", "640|642")]).replace("c_cur", "cur").replace("c_prev", "prev"),
    "anchored_summary": _summary_sql(CONCEPTS, anchored=True),
    "pattern_table": _summary_sql([(f"k{n}", name, p) for n, (name, p) in enumerate(PATTERNS.items())]),
    "yoy_change": _changes_sql(),
    "tax_tier": _from_totals(
        "ventas_cur AS ventas, CASE WHEN ventas_cur < 1000000 THEN 0.23::DOUBLE ELSE 0.25::DOUBLE END AS rate"
    ),
    "margins": _from_totals(
        f"round({MARGIN_SQL}, 6) + 0 AS margin, round({EFFECTIVE_SQL}, 6) + 0 AS effective_rate"
    ),
    "alerts": _from_totals(", ".join(f"{sql} AS {name}" for name, sql in ALERTS_SQL.items())),
    "main_driver": _from_totals(f"{DRIVER_SQL} AS driver"),
    "screening": _from_totals(
        "CASE WHEN {} THEN 'review' ELSE 'stable' END AS screening".format(
            " OR ".join(
                [sql for name, sql in ALERTS_SQL.items() if name != "new_assets"]
                + [_moved_sql("amortizaciones", LIMITS.amortization_pct)]
            )
        )
    ),
    "letter": _letter_sql(),
    "prompt_batch": _prompt_sql(),
    "letter_files": _letter_sql(by="branch"),
    "folder_close": SUMMARY_BY_BRANCH_SQL,
    "folder_lines": LINES_SQL,
    "mixed_folder_lines": LINES_SQL,
    "folder_letters": _letter_sql(),
    "arrivals_close": SUMMARY_BY_BRANCH_SQL,
    "arrivals_letters": _letter_sql(by="branch"),
    "pattern_index": f"""
        WITH l AS ({ledger_sql()}),
             p AS (SELECT unnest([{_quoted(LONG_PATTERNS)}]) AS concept, unnest([{_quoted(LONG_PATTERNS.values())}]) AS pattern),
             hit AS (SELECT DISTINCT label, concept FROM (SELECT DISTINCT label FROM l), p
                     WHERE regexp_matches(label, pattern, 'i')),
             sums AS (SELECT client, concept, sum(amount) FILTER (WHERE year = {CUR}) AS cur,
                             sum(amount) FILTER (WHERE year = {PREV}) AS prev
                      FROM l JOIN hit USING (label) GROUP BY ALL)
        SELECT c.client, p.concept, CAST(coalesce(cur, 0) AS DOUBLE) AS y{CUR}, CAST(coalesce(prev, 0) AS DOUBLE) AS y{PREV}
        FROM (SELECT DISTINCT client FROM l) c CROSS JOIN p
             LEFT JOIN sums s ON s.client = c.client AND s.concept = p.concept""",
    "landed_summary": _summary_sql(CONCEPTS),
    "damaged_ledgers": f"""
        SELECT branch AS client, count(*) FILTER (WHERE damaged) AS damaged, count(*) FILTER (WHERE NOT damaged) AS kept,
               CAST(sum(amount) FILTER (WHERE NOT damaged) AS DOUBLE) AS amount
        FROM (SELECT *, (l_orderkey + l_partkey) % {DAMAGED_EVERY} = 0 AS damaged FROM ({ledger_sql('l_orderkey, l_partkey')}))
        GROUP BY 1""",
    "packed_letters": _letter_sql(),
    "account_sums": f"""
        SELECT client, regexp_extract(label, '^\\s*(\\d{{3}})', 1) AS account,
               CAST(sum(CASE WHEN year = {CUR} THEN amount ELSE 0 END) AS DOUBLE) AS y{CUR},
               CAST(sum(CASE WHEN year = {PREV} THEN amount ELSE 0 END) AS DOUBLE) AS y{PREV}
        FROM ({ledger_sql()}) WHERE regexp_matches(label, '^\\s*\\d{{3}}') GROUP BY ALL""",
    "extended_summary": _summary_sql(EXTENDED),
    "amount_texts": """
        SELECT l_suppkey AS client,
               count(*) FILTER (WHERE l_discount = 0) AS unreadable,
               count(*) FILTER (WHERE l_discount <> 0 AND l_tax >= 0.07::DOUBLE AND l_extendedprice >= 1000) AS english
        FROM lineitem GROUP BY 1""",
}
