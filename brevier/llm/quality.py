"""Line-first cleaning.

Every line with a word is judged by its own rules: punctuation (symbols, shouting, a line of
at most ``SHORT`` words that no sentence mark ends), navigation (bar-separated menus, one
word over and over) and boilerplate phrases in English, German, French and Spanish.  Failing lines are removed; a document that loses more than
``MAX_LOST`` of its word characters, or fails the base limits, is rejected.

Base limits: fewer than 10 words, or over 20 % of the words inside 5-word windows that
occur twice or more in the text.

Defined cases: a null text has no words and is rejected; very long texts are judged whole;
repeated rows are judged alike; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hof import bind, total

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, MAX_LOST = 10, 20, 5, 0.3
MAX_SYMBOLS, MAX_SHOUTS, MIN_BARS, MAX_BARS, MIN_DISTINCT = 0.1, 0.3, 2, 0.2, 0.3
SHORT, SENTENCE_END = 8, "[.!?:;\u2026\u3002\uff01\uff1f\"\u201d\u00bb)][\\x20\\x09-\\x0D]*$"
#: Phrases of page furniture, compared without case.
BOILERPLATE = (
    "click here|read more|sign up|log in|subscribe now|cookie policy|privacy policy|terms of use|"
    "terms of service|enable javascript|lorem ipsum|share this|skip to content|back to top|"
    "hier klicken|weiterlesen|jetzt anmelden|datenschutzerkl\u00e4rung|nutzungsbedingungen|zum inhalt springen|nach oben|"
    "cliquez ici|lire la suite|se connecter|politique de confidentialit\u00e9|conditions d'utilisation|aller au contenu|haut de page|"
    "haga clic aqu\u00ed|leer m\u00e1s|iniciar sesi\u00f3n|pol\u00edtica de privacidad|t\u00e9rminos de uso|saltar al contenido|volver arriba"
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words covered by ``width``-word windows that occur at least twice.

    Window hashes are compared first; only a text with equal ones pays for the second step,
    which sorts (hash, place) and adds up the covered words from the places in order.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(runs: Column) -> Column:
        twin = lambda x, j: (
            F.coalesce(x["h"] == F.get(runs, j - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(runs, j + 1)["h"], F.lit(False))
        )
        return F.array_sort(F.transform(F.filter(runs, twin), lambda x: x["i"]))

    def cover(places: Column) -> Column:
        gaps = F.transform(places, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(places, j + 1) - p, F.lit(width))))
        return total(gaps)

    exact = bind(placed, lambda runs: bind(same(runs), cover))
    none = F.lit(0).cast("long")
    found = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact).otherwise(none))
    return F.when(n >= 2 * width - (width - 1), found).otherwise(none)


def line_fails(line: Column) -> Column:
    """Whether a line that has a word breaks a rule."""

    def judge(words: Column) -> Column:
        n = F.size(words)
        chars = F.length(F.concat_ws("", words))
        symbols = F.regexp_count(line, F.lit(SYMBOLS)) > MAX_SYMBOLS * chars
        shouts = F.regexp_count(line, F.lit("!{2,}")) > MAX_SHOUTS * n
        bars = F.regexp_count(line, F.lit(r"\|"))
        menu = (bars >= MIN_BARS) & (bars > MAX_BARS * n)
        same = (n >= MIN_WORDS) & (F.size(F.array_distinct(words)) < MIN_DISTINCT * n)
        furniture = (n <= 12) & F.lower(line).rlike(BOILERPLATE)
        fragment = (n <= SHORT) & ~line.rlike(SENTENCE_END)
        return symbols | shouts | menu | same | furniture | fragment

    return bind(words_of(line), judge)


def judge_documents(docs: DataFrame) -> DataFrame:
    """All of ``docs`` with a struct column ``quality``: counts, clean_text, verdicts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.struct("*").alias("doc"), text.alias("t"))
    d = d.withColumn("words", words_of(F.col("t")))
    worded = F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^" + SPACE[1:]))
    d = d.withColumn("worded", worded)
    lines = F.transform("worded", lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails")))
    d = d.withColumn("lines", lines)
    good = F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"])
    d = d.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.concat_ws("", "words")).cast("long"),
            "n_symbols": F.regexp_count("t", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("words")),
            "clean_text": F.concat_ws("\n", good),
        }
    )
    d = d.withColumn("clean_chars", F.length(F.regexp_replace("clean_text", SPACE, "")).cast("long"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.col("clean_chars") < (1 - MAX_LOST) * F.col("word_chars")
    d = d.withColumns({"base_failed": base, "kept": ~(base | lost)})
    found = F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "clean_chars", "base_failed", "kept", "clean_text",
    )
    # a generator keeps filters on the verdict from being written out over all of the above
    return d.select("doc", F.explode(F.array(found)).alias("quality"))
