"""Operator 1, quality rules: line-first cleaning.

Each line of a document is tried against three kinds of rules; lines that fail
are removed, and a document that loses too much of its text, by whichever rule,
is rejected.

* punctuation: the line ends without a closing mark and holds no finished
  sentence; or symbols make up more than `symbol_share` of it; or it is
  written in capitals only (20 characters or more).
* navigation: `separators` or more of ``| » › · • >``, or the line is nothing
  but a menu word such as "next" or "log in".
* boilerplate: licence and copyright lines, cookie and script notices.

Menu words and notices are those of English, German, French and Spanish pages.

Defined results: a null or blank text has no lines and is rejected with
``kept_share`` 0. Texts and lines of any length are judged whole. A line of closing marks alone passes. A text in which every line passes is returned unchanged;
otherwise the kept lines are joined by newlines and blank lines go. Rows are
judged one by one, so repeated rows get equal results and an empty table gives
an empty result. Other columns, also of names used here, are left out of
`judge` (it reads `doc_id` and `text` alone) and kept as they are by `apply`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#$%&*+<=>@[]^_`{|}~\\"
CLOSING = ".!?…\"'”’»)]:;。！？"
SEPARATORS = "|»›·•>"
_MENU_WORDS = (
    "home|menu|log ?in|sign (in|up)|search|contact( us)?|about( us)?|next( page)?|previous|back to top|read more|share|subscribe|sitemap|skip to content"
    "|startseite|anmelden|abmelden|registrieren|suchen?|kontakt|impressum|datenschutz|über uns|weiter(lesen)?|zurück|nach oben|mehr (lesen|erfahren)|teilen|abonnieren"
    "|accueil|(se )?connexion|se connecter|s.inscrire|rechercher?|contactez[- ]nous|à propos|suivant|précédent|retour en haut|lire la suite|partager|s.abonner|plan du site|mentions légales"
    "|inicio|iniciar sesión|registrarse|buscar|contacto|acerca de|siguiente|anterior|volver arriba|leer más|compartir|suscribirse|mapa del sitio|aviso legal"
)
MENU = rf"^({_MENU_WORDS})[ .!]*$"
BOILERPLATE = (
    r"all rights reserved|(licensed|released|distributed) under|copyright (©|\(c\))|©|(cookie|privacy) policy|terms of (use|service)"
    r"|(enable|requires|disabled) javascript|javascript (is|must be) |(we|this site) uses? cookies|lorem ipsum"
    r"|alle rechte vorbehalten|(lizenziert|veröffentlicht) unter|cookie-richtlinie|datenschutz(erklärung|richtlinie|bestimmungen)|nutzungsbedingungen|verwende[nt] cookies|javascript (aktivieren|erforderlich)"
    r"|tous droits réservés|sous licence|politique de confidentialité|conditions (générales )?d.utilisation|utilis(e|ons) des cookies|activer javascript"
    r"|todos los derechos reservados|bajo (la )?licencia|política de (privacidad|cookies)|términos (y condiciones|de uso|de servicio)|utiliza(mos)? cookies|activar javascript"
)
#: One of these is in every line that BOILERPLATE finds; the pattern is tried on such lines alone.
_HINTS = ("©", "cookie", "javascript", "lorem ipsum", "rights reserved", "under", "copyright", "privacy policy", "terms of", "unter", "datenschutz", "nutzungsbedingungen", "rechte vorbehalten", "licenc", "réservés", "confidentialité", "utilisation", "reservados", "política de", "términos")


def _verdicts(text: F.Column, symbol_share: float, separators: int) -> F.Column:
    def judge(x: F.Column) -> F.Column:
        t, low, n = x["t"], x["low"], x["n"]
        lost = lambda chars: n - F.length(F.translate(t, chars, ""))
        code = (
            F.when((lost(SEPARATORS) >= separators) | low.rlike(MENU), 2)
            .when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in _HINTS)) & low.rlike(BOILERPLATE), 3)
            .when(F.length(F.translate(F.substring(t, -1, 1), CLOSING, "")).eqNullSafe(1) & ~t.rlike("[.!?…] "), 1)
            .when(lost(SYMBOLS) > F.lit(symbol_share) * n, 1)
            .when((n >= 20) & (low != t) & (F.upper(t) == t), 1)
            .otherwise(0)
        )
        return F.struct(x["line"].alias("line"), code.alias("code"), F.length(x["line"]).alias("size"))

    # each step is a transform of its own, so that what a line needs again is computed once
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(x.alias("line"), F.trim(x).alias("t")))
    lines = F.transform(F.filter(lines, lambda x: x["t"] != ""), lambda x: F.struct(x["line"].alias("line"), x["t"].alias("t"), F.lower(x["t"]).alias("low"), F.length(x["t"]).alias("n")))
    return F.transform(lines, judge)


def judge(docs: DataFrame, min_share: float = 0.5, symbol_share: float = 0.1, separators: int = 3) -> DataFrame:
    """One row per document: its cleaned text, what each rule removed, and whether it is kept."""
    # a generator of one row: the optimiser does not copy the rules into the filters and columns that use their result
    d = docs.select("doc_id", "text", F.explode(F.array(_verdicts(F.col("text"), symbol_share, separators))).alias("marks"))
    kept = F.filter("marks", lambda m: m["code"] == 0)
    hits = lambda k: F.size(F.filter("marks", lambda m: m["code"] == k)).cast("bigint")
    chars = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, m: s + m["size"])
    d = d.select(
        "doc_id",
        "text",
        kept.alias("kept"),
        F.size("marks").cast("bigint").alias("n_lines"),
        hits(1).alias("n_punctuation"),
        hits(2).alias("n_navigation"),
        hits(3).alias("n_boilerplate"),
        chars(F.col("marks")).alias("chars_in"),
    ).withColumn("chars_kept", chars(F.col("kept")))
    share = F.when(F.col("chars_in") > 0, F.col("chars_kept") / F.col("chars_in")).otherwise(F.lit(0.0))
    return d.select(
        "doc_id",
        "n_lines",
        "n_punctuation",
        "n_navigation",
        "n_boilerplate",
        "chars_in",
        "chars_kept",
        F.round(share, 6).alias("kept_share"),
        ((share >= min_share) & (F.col("chars_kept") > 0)).alias("keep"),
        F.when(F.size("kept") == F.col("n_lines"), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(F.transform("kept", lambda m: m["line"]), "\n"))
        .alias("clean_text"),
    )


def apply(docs: DataFrame, **rules) -> DataFrame:
    """Documents that stay, with their cleaned text; the columns are those of `docs`."""
    names = docs.columns
    inner = docs.select(F.struct(*(docs[c] for c in names)).alias("row"))
    verdict = judge(inner.select(inner["row"].alias("doc_id"), inner["row"]["text"].alias("text")), **rules).filter("keep")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("bigint")}
    return verdict.select(*(new.get(c, F.col("doc_id")[c]).alias(c) for c in names))


ORACLE = f"""
with l as (select doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') as lines from documents),
m as (select doc_id, text, list_transform(lines, lambda x: {{'line': x, 'code': case
  when length(trim(x)) - length(translate(trim(x), '{SEPARATORS}', '')) >= 3 or regexp_matches(lower(trim(x)), '{MENU}') then 2
  when regexp_matches(lower(trim(x)), '{BOILERPLATE}') then 3
  when length(translate(right(trim(x), 1), '{CLOSING.replace("'", "''")}', '')) = 1 and not regexp_matches(trim(x), '[.!?…] ') then 1
  when length(trim(x)) - length(translate(trim(x), '{SYMBOLS}', '')) > 0.1::double * length(trim(x)) then 1
  when length(trim(x)) >= 20 and upper(trim(x)) = trim(x) and lower(trim(x)) <> trim(x) then 1
  else 0 end}}) as marks from l),
k as (select doc_id, text, list_filter(marks, lambda x: x.code = 0) as kept, len(marks) as n_lines,
  len(list_filter(marks, lambda x: x.code = 1)) as n_punctuation, len(list_filter(marks, lambda x: x.code = 2)) as n_navigation,
  len(list_filter(marks, lambda x: x.code = 3)) as n_boilerplate,
  coalesce(list_sum(list_transform(marks, lambda x: length(x.line))), 0)::bigint as chars_in from m),
s as (select *, coalesce(list_sum(list_transform(kept, lambda x: length(x.line))), 0)::bigint as chars_kept from k)
select doc_id, n_lines, n_punctuation, n_navigation, n_boilerplate, chars_in, chars_kept,
  round(case when chars_in > 0 then chars_kept::double / chars_in else 0 end, 6) as kept_share,
  chars_kept > 0 and chars_kept::double / greatest(chars_in, 1) >= 0.5 as keep,
  case when len(kept) = n_lines then coalesce(text, '') else array_to_string(list_transform(kept, lambda x: x.line), chr(10)) end as clean_text
from s
"""
