"""The conversational layer: what kind of question, how good the contexts, which prompt, which citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import overlap_ratio, strip, words

# Words that tell the kinds of question.
FOLLOWUP = ("what about", "how about", "and what", "also", "in addition", "furthermore", "moreover", "can you explain", "tell me more", "elaborate", "go on", "continue", "next")
CLARIFICATION = ("what do you mean", "what does that mean", "clarify", "explain that", "i don't understand", "unclear", "confusing", "rephrase", "say that again", "what is", "define", "meaning of")
REFERENCES = ("that", "this", "it", "they", "those", "these", "he", "she", "him", "her", "them")
COMMON = ("the", "is", "are", "was", "were", "what", "when", "where", "who", "how", "why", "can", "will", "does")
OVERLAP, SHORT, KEPT_MESSAGES, THRESHOLD = 0.3, 5, 10, 0.3
BANDS = (("high", 0.7), ("medium", 0.5), ("low", 0.3))
SYSTEM = "You answer from the given passages alone, name your sources, and say so when they don't hold the answer."
SYSTEM_CONCISE = "You answer briefly, from the given passages alone."

#: Answers where no model gives one, by the contexts' quality.
FALLBACKS = {
    "high": "The passages found should answer this, but no answer could be made just now. Please read the sources.", "medium": "Some of the passages found may answer this, but no answer could be made just now.",
    "low": "Little was found on this, and no answer could be made just now. Please ask more precisely.", "none": "Nothing was found on this. Please ask in other words.",
}


def keywords(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))), F.array(*map(F.lit, COMMON)))


def classify(query: Column, n_history: Column, last_user: Column) -> Column:
    """new, followup or clarification, from the question, how many messages came before and the last one of the user."""
    q = strip(F.lower(query))
    tokens, listed = words(q), lambda ws: F.array(*map(F.lit, ws))
    holds = lambda ws: F.exists(listed(ws), lambda w: F.contains(q, w))
    clarifies = holds(CLARIFICATION) | (F.contains(q, F.lit("?")) & F.arrays_overlap(tokens, listed(REFERENCES[:6])))
    topic = (n_history >= 2) & F.coalesce(overlap_ratio(keywords(query), keywords(last_user)) > OVERLAP, F.lit(False))
    follows = holds(FOLLOWUP) | q.rlike(r"^(and|but|also|or)\b") | topic
    refers = F.coalesce(F.get(tokens, F.lit(0)).isin(*REFERENCES), F.lit(False)) | (F.size(F.filter(tokens, lambda w: w.isin(*REFERENCES))) >= 2)
    return F.when(n_history == 0, "new").when(clarifies, "clarification").when(follows | refers | (F.size(tokens) <= SHORT), "followup").otherwise("new")


def classify_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, text, n_history, last_user, last_assistant, query_type of each user turn. History is what users and
    assistants said before, the last ten messages of it; other roles are left out."""
    said = conversations.where(F.col("role").isin("user", "assistant"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-KEPT_MESSAGES, -1)
    of = lambda role: F.last(F.when(F.col("role") == role, F.col("text")), ignorenulls=True).over(before)
    with_history = said.withColumns({"n_history": F.count("*").over(before), "last_user": of("user"), "last_assistant": of("assistant")})
    asked = with_history.where("role = 'user'")
    return asked.select("conv_id", "turn", "text", "n_history", "last_user", "last_assistant", classify(F.col("text"), F.col("n_history"), F.col("last_user")).alias("query_type"))


def history(conversations: DataFrame, keep: int = KEPT_MESSAGES) -> DataFrame:
    """The last ``keep`` messages of each conversation."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return conversations.where(F.col("role").isin("user", "assistant")).withColumn("__n", last).where(F.col("__n") <= keep).drop("__n")


def quality(score: Column) -> Column:
    out = F.lit("none")
    for name, least in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def citation(source_file: Column, hierarchy: Column, pages: Column) -> Column:
    where = F.when(F.size(hierarchy) > 0, F.array_join(hierarchy, " > ")).otherwise("Document")
    page = F.when(F.size(pages) > 0, F.concat(F.lit(", p. "), F.array_join(F.transform(pages, lambda p: p.cast("string")), ","))).otherwise("")
    return F.concat(F.coalesce(source_file, F.lit("")), F.lit(" ("), where, page, F.lit(")"))


def citations(contexts: Column, most: int = 3, least: float = 0.5) -> Column:
    """Of an array of contexts in order: the first ``most``, then those of at least ``least``."""
    return F.transform(F.filter(F.slice(contexts, 1, most), lambda c: c["score"] >= least), lambda c: citation(c["source_file"], c["hierarchy"], c["page_numbers"]))


# How contexts and citations are laid out.
def context_text(contexts: Column, most: int = 5) -> Column:
    where = lambda c: F.when(F.size(c["hierarchy"]) > 0, F.array_join(c["hierarchy"], " > ")).otherwise("Document")
    block = lambda c, i: F.concat(F.lit("[Context "), (i + 1).cast("string"), F.lit("] (Score: "), F.format_string("%.2f", c["score"]), F.lit(")\nSource: "), F.coalesce(c["source_file"], F.lit("None")), F.lit("\nSection: "), where(c), F.lit("\nContent: "), c["text"], F.lit("\n"))
    return F.array_join(F.transform(F.slice(contexts, 1, most), block), "\n")


def prompt_kind(query_type: Column, band: Column) -> Column:
    new = F.when(band == "high", "answer").when(band.isin("medium", "low"), "answer_with_care").otherwise("no_context")
    follow = F.when(band.isin("high", "medium"), "follow_up").otherwise("follow_up_no_context")
    return F.when(query_type == "new", new).when(query_type == "followup", follow).when(query_type == "clarification", "clarify").otherwise(F.when(band == "high", "answer").otherwise("answer_with_care"))


def prompt(kind: Column, query: Column, contexts: Column, cited: Column, last_user: Column, last_assistant: Column) -> Column:
    """The prompt of a kind, filled in; what is missing of the conversation has a placeholder."""
    q, a = F.coalesce(last_user, F.lit("Previous question")), F.coalesce(last_assistant, F.lit("Previous answer"))
    part = lambda name, value: F.concat(F.lit(f"{name}:\n"), value)
    sources, asked = part("Sources", F.array_join(cited, "\n")), part("Question", query)
    lay = lambda text, *parts: F.concat_ws("\n\n", F.lit(text), *parts)
    passages, earlier = part("Passages", contexts), (part("Earlier question", q), part("Earlier answer", a))
    return (
        F.when(kind == "answer", lay("Answer the question from these passages and cite them.", passages, sources, asked))
        .when(kind == "answer_with_care", lay("These passages may answer the question only in part. Say what they leave open.", passages, sources, asked))
        .when(kind == "no_context", lay("No passage was found. Say so, and suggest how to ask better.", asked))
        .when(kind == "follow_up", lay("Continue the conversation from these passages.", *earlier, passages, asked))
        .when(kind == "follow_up_no_context", lay("Continue the conversation; no new passage was found.", *earlier, asked))
        .otherwise(lay("Explain the earlier answer more clearly.", part("Earlier answer", a), passages, asked))
    )
