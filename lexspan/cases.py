"""Sentences put together from parts that the order table picks, and what the scan must give, stated in SQL from the same parts.

Each family exercises the rules that its docstring names, over one text for each order. The text is one SQL expression for
both engines; what comes out is stated only in SQL, from the parts and not from the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators import harness
from lexspan.plans import plain_meaning as plan
from lexspan.runtime import table

K = "o_orderkey"
#: Picks that are independent enough of each other to meet in all combinations.
BY = {3: "o_orderkey % 3", 4: "o_custkey % 4", 5: "(o_orderkey + o_custkey) % 5", 6: "(o_orderkey + 2 * o_custkey) % 6", 7: "(o_orderkey + 3 * o_custkey) % 7", 8: "(o_orderkey + 5 * o_custkey) % 8", 2: "(o_orderkey + 7 * o_custkey) % 9 % 2"}


def say(s: str) -> str:
    """A text in SQL, with # for the order's key."""
    return "(" + f" || {K} || ".join("'" + p.replace("'", "''") + "'" for p in s.split("#")) + ")"


def pick(*texts: str | None, by: str | None = None) -> str:
    """One of the texts."""
    on = by or BY[len(texts)]
    return f"(CASE {on} " + " ".join(f"WHEN {i} THEN {'NULL' if t is None else say(t)}" for i, t in enumerate(texts)) + " END)"


def parsed(spark: SparkSession, folder: str, text: str, *fields: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(K, F.expr(text.replace("VARCHAR", "STRING")).alias("text"))
    return plan.plain_meaning(rows, "text", fields=fields)


def joined(c: str, *names: str):
    """Structs of an array as text."""
    return F.array_join(F.transform(c, lambda x: F.concat_ws("=", *[F.coalesce(x[n].cast("string"), F.lit("-")) for n in names])), "|")


# Parts --------------------------------------------------------------------------------------------------

ACTOR = pick("The board", "The agency director", "Each licensed seller")
RELATIVE = pick("", " that must hold lot #", " which may not sell lot #", " who shall renew permit #")
MODAL = pick("shall", "may", "may not", "must", "shall not")
FORCE = {"shall": "must", "must": "must", "may": "may", "may not": "cannot"}
SIGNALS_TEXT = f"{ACTOR} || {RELATIVE} || ' ' || {MODAL} || {say(' keep file #.')}"
SIGNALS_SQL = f"""SELECT {K}, {pick("obligation", "permission", "prohibition", "obligation", "prohibition")} AS signal, {ACTOR} || {pick("", " that", " which", " who")} AS actor,
  coalesce({pick(None, "must", "may not", "shall")}, {MODAL}) AS modal, coalesce({pick(None, "hold lot # ", "sell lot # ", "renew permit # ")} || {MODAL} || ' ', '') || {say("keep file #")} AS action,
  {pick("", "that=that must hold lot #=obligation", "which=which may not sell lot #=prohibition", "who=who shall renew permit #=obligation")} AS subordinate,
  {pick("missing_enforcement", "", "", "missing_enforcement", "")} AS missing, 1 AS n_units FROM orders"""


def case_signals(spark: SparkSession, folder: str) -> DataFrame:
    """signal, relative_clauses, clause_span, demonstrative_that, modal_find, actor_action, missing_signals."""
    u = F.col("u")
    rows = parsed(spark, folder, SIGNALS_TEXT, "units").select(K, F.col("result.units")[0].alias("u"), F.size("result.units").alias("n_units"))
    return rows.select(K, "u.signal", "u.actor", "u.modal", "u.action", joined("u.subordinate", "marker", "clause_text", "signal").alias("subordinate"), F.array_join(u["missing"], "|").alias("missing"), "n_units")


FRONT = pick("", "If fee # is unpaid, ", "When asked by the board, ", "Unless rule #, as amended, applies, ")
TAIL = pick("", " if notice # is late", " unless the board objects, and the clerk must keep a copy", " subject to rule #; other terms apply", " upon request", by="(o_orderkey + o_custkey) % 5")
CONDITIONS_TEXT = f"{FRONT} || {pick('The', 'the', 'the', 'the')} || ' owner ' || {pick('shall', 'must', 'may')} || {say(' file form #')} || {TAIL} || '.'"
CONDITIONS_SQL = f"""SELECT {K}, {pick('The', 'the', 'the', 'the')} || ' owner' AS actor, {say("file form #")} || {pick("", " if notice # is late", " unless the board objects,", " subject to rule #; other terms apply", " upon request")} AS action,
  array_to_string(list_filter([{pick(None, "If fee # is unpaid", None, None)}, {pick(None, "if notice # is late", None, None, None)}, {pick(None, None, "When asked by the board", None)}, {pick(None, None, None, "Unless rule #, as amended, applies")},
    {pick(None, None, "unless the board objects", None, None)}, {pick(None, None, None, "subject to rule #", None)}, {pick(None, None, None, None, "upon request")}], lambda x: x IS NOT NULL), '|') AS conditions,
  {pick(None, None, "the clerk=must=keep a copy", None, None)} AS second FROM orders"""


def case_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """fronted_end, cond_extract, cond_end, indep_start, coord_start, second_instruction, aac."""
    rows = parsed(spark, folder, CONDITIONS_TEXT, "units").select(K, F.col("result.units").alias("us"))
    u = F.col("us")[0]
    two = F.try_element_at("us", F.lit(2))
    return rows.select(K, u["actor"].alias("actor"), u["action"].alias("action"), F.array_join(u["conditions"], "|").alias("conditions"), F.when(F.size("us") > 1, F.concat_ws("=", two["actor"], two["modal"], two["action"])).alias("second"))


LISTS_TEXT = say("The buyer shall keep ") + " || " + pick(
    "all records including but not limited to invoice #, receipts, and letters", "fees (including permit fee #) on file", "copies, not including draft #",
    "a list of including entry #", "records, including invoices and lot #, if asked", "a report including: costs of lot # and gains") + " || '.'"
LISTS_SQL = f"""SELECT {K}, {pick("SENTENCE_END", "PARENTHETICAL", "REVERSED", "NOT_A_LIST", "COMMA_BOUNDED", "COLON_SUBLIST")} AS classification,
  {pick("including but not limited to invoice #, receipts, and letters", "including permit fee #", None, None, "including invoices and lot #", "including: costs of lot # and gains")} AS list_text,
  {BY[6]} NOT IN (2, 3) AS extracted,
  {pick("keep all records", "keep fees on file", "keep copies, not including draft #", "keep a list of including entry #", "keep records, if asked", "keep a report")} AS action,
  {pick("The buyer must keep all records. Named examples: invoice #, receipts, and letters.", "The buyer must keep fees on file. Named examples: permit fee #.", "The buyer must keep copies, not including draft #.",
        "The buyer must keep a list of including entry #.", "The buyer must keep records, if asked. Named examples: invoices and lot #.", "The buyer must keep a report. Named examples: costs of lot # and gains.")} AS sentence FROM orders"""  # fmt: skip


def case_lists(spark: SparkSession, folder: str) -> DataFrame:
    """incl_scan, its gates, fillers, ends and excision, incl_notes, tpl_modality."""
    rows = parsed(spark, folder, LISTS_TEXT, "units").select(K, F.col("result.units")[0].alias("u")).select(K, "u", F.col("u.inclusion_lists")[0].alias("x"))
    return rows.select(K, "x.classification", "x.list_text", "x.extracted", "u.action", "u.sentence")


VALUES_TEXT = pick(
    "The agency may waive fee # as the board deems equitable.", "The office may suspend permit # if the director finds that good cause exists.", "The owner shall give reasonable notice of sale #.",
    '"fair dealing #" means a sale made in the open market.', "The buyer shall use adequate tools for lot #.", "The fee for lot # must be fair as determined by the commission.", "The board shall set a fair rate as defined under RCW #.1.")
VALUES_SQL = f"""SELECT {K}, {pick("equitable=delegated=the board=as the board deems equitable", "good cause=delegated=the director=if the director finds that good cause exists", "reasonable=open=-=-",
    "fair dealing #=internal=-=means", "", "fair=delegated=the commission=as determined by the commission", "")} AS found FROM orders"""


def case_values(spark: SparkSession, folder: str) -> DataFrame:
    """val_delegated, val_holder, val_open, val_internal, val_union, lexicons."""
    rows = parsed(spark, folder, VALUES_TEXT, "units").select(K, F.col("result.units")[0].alias("u"))
    return rows.select(K, joined("u.values", "value_term", "resolution_state", "resolution_holder", "cue").alias("found"))


LIST_MODAL = pick("shall", "may", "must not")
BINDINGS_TEXT = f"'The office ' || {LIST_MODAL} || {say(': (a) Keep file # in order. (b) Publish the list of lot #. ')} || {pick('(2) Fees for lot # apply in full.', '(c) The board is exempt from rule #.', 'Other matters of lot # follow here.', '(c) Store the letters of lot #.')}"
BINDINGS_SQL = f"""SELECT {K}, CASE WHEN {BY[4]} = 3 THEN 3 ELSE 2 END AS n_units, 'The office=' || {LIST_MODAL} || '=' || {pick("obligation", "permission", "prohibition")} || {say("=Publish the list of lot #.")} AS second,
  CASE WHEN {BY[4]} = 3 THEN 'The office=' || {LIST_MODAL} || '=' || {pick("obligation", "permission", "prohibition")} || {say("=Store the letters of lot #.")} END AS third FROM orders"""


def case_bindings(spark: SparkSession, folder: str) -> DataFrame:
    """item_independent, list_lead_in, list_bindings, bind_inherit, signal_for_modal."""
    rows = parsed(spark, folder, BINDINGS_TEXT, "units").select(K, F.col("result.units").alias("us"))
    shown = lambda i: F.when(F.size("us") >= i, F.concat_ws("=", *[F.try_element_at("us", F.lit(i))[n] for n in ("actor", "modal", "signal", "action")]))
    return rows.select(K, F.size("us").alias("n_units"), shown(2).alias("second"), shown(3).alias("third"))


FIRST_MODAL, NEXT_MODAL = pick("shall", "must", "may"), pick("may not", "must", "shall", "may")
COORDINATE_TEXT = f"{ACTOR} || ' ' || {FIRST_MODAL} || {say(' keep file # and ')} || {NEXT_MODAL} || {say(' sell lot #.')}"
COORDINATE_SQL = f"""SELECT {K}, 1 AS n_units, {ACTOR} || ' ' || {pick("must", "must", "may")} || {say(" keep file #.")} || chr(10) || chr(10) || {ACTOR} || ' ' || {pick("cannot", "must", "must", "may")} || {say(" sell lot #.")} AS plain_meaning FROM orders"""


def case_coordinate(spark: SparkSession, folder: str) -> DataFrame:
    """coord_split, modal_verb, render_unit, render_isc."""
    return parsed(spark, folder, COORDINATE_TEXT, "units", "plain_meaning").select(K, F.size("result.units").alias("n_units"), "result.plain_meaning")


PAIR_TEXT = f"{ACTOR} || ' ' || {FIRST_MODAL} || {say(' keep file #, and the clerk ')} || {pick('must', 'shall')} || {say(' check lot #.')}"
PAIR_SQL = f"""SELECT {K}, {ACTOR} || {say(" must keep file #.")} || chr(10) || chr(10) || {say("The clerk must check lot #.")} AS plain_meaning, {FIRST_MODAL} AS first_modal, 'the clerk' AS second_actor, {pick('must', 'shall')} AS second_modal FROM orders"""


def case_two_actors(spark: SparkSession, folder: str) -> DataFrame:
    """second_instruction, aac: the signal of the whole sentence overrides a first modal that only permits."""
    rows = parsed(spark, folder, PAIR_TEXT, "units", "plain_meaning").select(K, "result.plain_meaning", F.col("result.units").alias("us"))
    return rows.select(K, "plain_meaning", F.col("us")[0]["modal"].alias("first_modal"), F.col("us")[1]["actor"].alias("second_actor"), F.col("us")[1]["modal"].alias("second_modal"))


RENDER = [
    ("The seller shall file report # within 30 days.", "threshold_shift", "The seller must file report #, within 30 days."), ("The board shall delegate review of lot #.", "actor_power_shift", "The board is responsible for delegating review of lot #."),
    ("The board may delegate review of lot #.", "actor_power_shift", "The board may delegate review of lot #."), ("The agency shall inspect lot #.", "action_domain_shift", "The agency must inspect lot #."),
    ("This chapter shall govern lot # throughout the state.", "scope_change", "This chapter must govern lot # throughout the state."),
    ("The owner of lot # is no longer required to post a bond.", "obligation_removal", "The owner of lot # is no longer required to post a bond."),
    ("The board may not delegate review of lot #.", "fallback", "The board may not delegate review of lot #."), ("The tenant of lot # shall pay rent.", "modality_shift", "The tenant of lot # must pay rent."),
]
RENDER_TEXT = pick(*[r[0] for r in RENDER])
RENDER_SQL = f"SELECT {K}, {pick(*[r[1] for r in RENDER])} AS lens, {pick(*[r[2] for r in RENDER])} AS sentence FROM orders"


def case_render(spark: SparkSession, folder: str) -> DataFrame:
    """lens, all templates, plainify, clean_actor, clean_action, already_present, gerund, L6 deadlines."""
    return parsed(spark, folder, RENDER_TEXT, "units").select(K, F.col("result.units")[0].alias("u")).select(K, "u.lens", "u.sentence")


SECTIONS = [
    ("NEW SECTION. Sec. 1. The board shall keep file #.", "addition", None, "New law — The board must keep file #."),
    ("RCW 1.2.3 is amended to read as follows: The board shall keep ((old)) file #.", "amendment", None, "Amends existing law — The board must keep file #."),
    ("RCW 1.2.3 and section # are each repealed.", "repeal", None, "RCW 1.2.3 and section # is no longer in effect."),
    ("This act takes effect on July 1, 2030. The board shall keep file #.", "delayed", "on July 1, 2030", "Effective on July 1, 2030 — The board must keep file #."),
    ("The sum of $5,000 is appropriated to the department of health for the purpose of lot #.", "appropriation", None, "Funding — $5,000 is allocated to the department of health for lot #."),
    ("This is a NEW SECTION on lot # and nothing else.", "standard", None, "No obligation or change detected in this section."),
]
SECTIONS_TEXT = pick(*[s[0] for s in SECTIONS])
SECTIONS_SQL = f"SELECT {K}, {pick(*[s[1] for s in SECTIONS])} AS section_type, {pick(*[s[2] for s in SECTIONS])} AS effective_date, {pick(*[s[3] for s in SECTIONS])} AS plain_meaning, {BY[6]} <> 5 AS has_content, {pick(None, None, None, None, None, 'no_units_supplied')} AS empty_reason FROM orders"


def case_sections(spark: SparkSession, folder: str) -> DataFrame:
    """section_type, track_amend, track_strike, render_repeal, render_approp, render_isc: a section without units is standard and has no prefix."""
    return parsed(spark, folder, SECTIONS_TEXT, "section_type", "effective_date", "plain_meaning", "has_content", "empty_reason").select(K, "result.*")


SECOND = pick("The board shall keep file #.", "The board must keep file #.", "A note on file # and nothing else.", "The agency shall keep file #. The board is required to keep file #.")
REPEATS_SQL = f"""SELECT {K}, section_pos, pos, paragraph FROM (SELECT {K}, 1 AS section_pos, {BY[4]} // 3 AS pos, {say("The board must keep file #.")} AS paragraph FROM orders WHERE {BY[4]} IN (1, 3))"""


def case_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """chk_C6, para_anchor: of two sections the second repeats the first from the same words, from others, not at all, or after another paragraph."""
    rows = table(spark, folder, "orders").select(K, F.posexplode(F.array(F.expr(say("The board shall keep file #.")), F.expr(SECOND))).alias("section_pos", "text"))
    parts = harness.paragraphs(plan.plain_meaning(rows, "text", fields=("units", "plain_meaning")), K, "section_pos")
    found = harness.repeated_paragraphs(parts.withColumn("at", F.struct("section_pos", "pos")), K, "at", "paragraph", "anchor")
    return found.select(K, "at.section_pos", "at.pos", "paragraph")


FAMILIES = {
    case_signals: SIGNALS_SQL, case_conditions: CONDITIONS_SQL, case_lists: LISTS_SQL, case_values: VALUES_SQL, case_bindings: BINDINGS_SQL,
    case_coordinate: COORDINATE_SQL, case_two_actors: PAIR_SQL, case_render: RENDER_SQL, case_sections: SECTIONS_SQL,
    case_repeats: REPEATS_SQL,
}
