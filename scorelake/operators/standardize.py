"""Free-text answers of listening models to fixed vocabularies, as column expressions.

Vocabularies are written with a number before each term: the numbers are the order of preference.
By default terms match at word boundaries and longer foreign terms are translated first; ``compat``
matches anywhere in the text and translates in table order, as older result files were made.
"""

from __future__ import annotations

import ast
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "qwen_"
_TERMS = {
    "speaker_gender": "1:Male 2:Female 3:Non-binary/unclear 4:Multiple speakers with mixed genders",
    "speaker_age": "1:Child 2:Teen 3:Young adult 4:Middle-aged adult 5:Senior",
    "speech_impairment": "1:No apparent impairment 2:Stuttering/disfluency 3:Articulation disorder 4:Voice disorder 5:Fluency disorder 6:Foreign accent 7:Dysarthria 8:Apraxia 9:Other impairment",
    "pitch_range": "1:Wide range 2:Moderate range 3:Narrow range 4:Monotone",
    "voice_pitch": "1:Very high 2:High 3:Medium 4:Low 5:Very low",
    "voice_type": "1:Clear 2:Breathy 3:Creaky/vocal fry 4:Hoarse 5:Nasal 6:Pressed/tense 7:Resonant 8:Whispered 9:Tremulous",
    "speech_volume_level": "1:Very quiet 2:Quiet 3:Moderate 4:Loud 5:Very loud 6:Variable",
    "language": "1:English 2:Spanish 3:Mandarin Chinese 4:Hindi 5:Arabic 6:French 7:Russian 8:Portuguese 9:German 10:Japanese 11:Other",
    "speech_register": " ".join(f"{i}:{w} register" for i, w in enumerate("Formal Standard Consultative Casual Intimate Technical Slang".split(), 1)),
    "vocabulary_complexity": "1:Basic 2:General 3:Advanced 4:Technical 5:Academic",
    "speech_purpose": "1:Informative 2:Persuasive 3:Entertainment 4:Narrative 5:Conversational 6:Instructional 7:Emotional expression",
    "speech_emotion": "1:Neutral 2:Happy 3:Sad 4:Angry 5:Fearful 6:Surprised 7:Disgusted 8:Other",
    "speech_clarity": " ".join(f"{i}:{w} clarity" for i, w in enumerate(("High", "Medium", "Low", "Very low"), 1)),
    "speech_rate": "1:Very slow 2:Slow 3:Medium 4:Fast 5:Very fast",
    "speaking_style": "1:Formal 2:Professional 3:Casual/conversational 4:Animated/enthusiastic 5:Deliberate 6:Dramatic 7:Authoritative 8:Hesitant",
    "laughter_crying": "1:No laughter or crying 2:Contains laughter 3:Contains crying 4:Contains both 5:Contains other emotional sounds 6:Contains multiple emotional vocalizations",
    "overlapping_speech": " ".join(f"{i}:{w} overlap" for i, w in enumerate("No Minimal Moderate Significant Constant".split(), 1)),
    "speech_background_environment": "1:Quiet indoor 2:Noisy indoor 3:Outdoor urban 4:Outdoor natural 5:Event/crowd 6:Music background 7:Multiple environments",
    "recording_quality": "1:Professional 2:Good 3:Fair 4:Poor 5:Very poor",
    "channel_type": "1:Professional microphone 2:Consumer microphone 3:Smartphone 4:Telephone/VoIP 5:Webcam/computer mic 6:Headset microphone 7:Distant microphone 8:Radio/broadcast 9:Surveillance/hidden mic",
}
VOCABULARY: dict[str, list[str]] = {k: [x.strip() for x in re.split(r"\d+:", v)[1:]] for k, v in _TERMS.items()}
NUMERIC = "speaker_count"
#: Kinds of answers that the allow-list keeps.
ALLOWED = [NUMERIC, *(k for k in VOCABULARY if k != "overlapping_speech")]
_FOREIGN = "慢=Slow|中等=Medium|快=Fast|很快=Very fast|很慢=Very slow|男=Male|女=Female|高=High|低=Low|中=Medium|很高=Very high|很低=Very low|明确=Clear|清晰=High clarity|不清晰=Low clarity|普通=Medium clarity|一般=Medium clarity|专业=Professional|良好=Good|一个=1|两个=2|三个=3|四个=4|五个=5"
TRANSLATION = dict(x.split("=") for x in _FOREIGN.split("|"))
NUMBER_WORDS = "one two three four five six seven eight nine ten".split()
ANSWER_PREFIXES = ("The category is", "Category:", "Answer:", "Output:", "The speaker count is", "Number of speakers:", "The number is", "Classification:", "The classification is")


def _translations(compat: bool) -> list[tuple[str, str]]:
    items = list(TRANSLATION.items())
    return items if compat else sorted(items, key=lambda x: -len(x[0]))


def translate(text: Column, compat: bool = False) -> Column:
    """The text in English as far as the table goes: parts are replaced one after another; spaces around a whole match go.

    Each step names the one before once, so the expression grows with the table and not with its power.
    A text without a letter of the table stays as it is, by a single test.
    """
    out = text
    for foreign, english in _translations(compat):
        out = F.replace(out, F.lit(foreign), F.lit(english))
    whole = (out != text) & F.trim(out).isin(*TRANSLATION.values())
    letters = "".join(sorted({t[0] for t in TRANSLATION}))
    return F.when(F.translate(text, letters, "") == text, text).otherwise(F.when(whole, F.trim(out)).otherwise(out))


def _has(low: Column, term: str, compat: bool) -> Column:
    term = term.lower()
    if compat:
        return low.contains(term)
    # the pattern is slow, and most terms don't occur at all
    return low.contains(term) & F.regexp_like(low, F.lit(r"(^|[^a-z0-9])" + re.escape(term).replace("/", "/") + r"($|[^a-z0-9])"))


def _first(low: Column, terms: list[str], compat: bool) -> Column:
    out = None
    for t in terms:
        test = _has(low, t, compat)
        out = F.when(test, t) if out is None else out.when(test, t)
    return out


def _closest(low: Column, terms: list[str], compat: bool) -> Column:
    """The term most of whose words occur; the first of the best, the first of all where no word does."""
    best, score = F.lit(terms[0]), F.lit(0)
    for t in terms:
        n = sum((_has(low, w, compat).cast("int") for w in t.split()[1:]), _has(low, t.split()[0], compat).cast("int"))
        best, score = F.when(n > score, F.lit(t)).otherwise(best), F.greatest(score, n)
    return best


def standardize(kind: str, text: Column, compat: bool = False) -> Column:
    """The vocabulary's term for an answer, as text; a kind without a vocabulary is only translated. Null stays null."""
    # bound once: the rules below name the translation many times
    return F.transform(F.array(translate(text, compat)), lambda e: _standard(kind, e, compat))[0]


def _standard(kind: str, english: Column, compat: bool) -> Column:
    low = F.lower(english)
    if kind == NUMERIC:
        digits = F.regexp_extract(english, r"(\d+)", 1)
        out = F.when(digits != "", F.least(F.greatest(F.coalesce(digits.try_cast("int"), F.lit(10)), F.lit(1)), F.lit(10)))
        for i, w in enumerate(NUMBER_WORDS, 1):
            out = out.when(_has(low, w, compat), F.lit(i))
        out = out.otherwise(F.lit(1)).cast("string")
    elif kind not in VOCABULARY:
        return english
    elif kind == "language":
        named = F.regexp_extract(english, r"(?i)(language|spoken) (?:is|in) ([\w\s]+)", 2)
        out = F.coalesce(_first(low, VOCABULARY[kind], compat), F.when(F.trim(named) != "", F.trim(named)), F.lit("English"))
    elif kind == "overlapping_speech":
        out = F.coalesce(F.when(_has(low, "no overlap", compat), "No overlap"), _first(low, VOCABULARY[kind], compat), F.lit("No overlap"))
    else:
        out = F.coalesce(_first(low, VOCABULARY[kind], compat), _closest(low, VOCABULARY[kind], compat))
    return F.when(english.isNotNull(), out)


def clean_answer(text: Column) -> Column:
    """A language model's answer without the openings it likes, in their order."""
    out = F.trim(text)
    for p in ANSWER_PREFIXES:
        out = F.regexp_replace(out, rf"^\Q{p}\E *", "")
    return out


def processed_answer(kind: str, text: Column) -> Column:
    """A cleaned answer; of a count the first number, 1 without any."""
    cleaned = clean_answer(text)
    if kind != NUMERIC:
        return cleaned
    return F.when(text.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(cleaned, r"(\d+)", 1), F.lit("")), F.lit("1")))


def answer_list(text: Column) -> Column:
    return F.transform(F.split(clean_answer(text), ","), F.trim)


def allowed(kind: str, value: Column) -> Column:
    """The value if it is a term of its vocabulary, or a whole number for a count; else null."""
    if kind == NUMERIC:
        text = F.trim(value.cast("string"))
        return F.when(F.regexp_like(text, F.lit(r"^[+-]?\d+$")), text.try_cast("bigint"))
    if kind not in VOCABULARY:
        return F.lit(None).cast("string")
    return F.when(value.isin(*VOCABULARY[kind]), value)


def allow_list(df: DataFrame, key: str = "key") -> DataFrame:
    """Key and the known answer columns, with values outside their vocabulary set to null; other columns go."""
    kinds = [k for k in ALLOWED if PREFIX + k in df.columns]
    return df.select(key, *(allowed(k, F.col(PREFIX + k)).alias(PREFIX + k) for k in kinds))


def standardize_row(df: DataFrame, compat: bool = False) -> DataFrame:
    """Every answer column brought to its vocabulary, other columns as they were."""
    kinds = [k for k in (NUMERIC, *VOCABULARY) if PREFIX + k in df.columns]
    return df.withColumns({PREFIX + k: standardize(k, F.col(PREFIX + k), compat) for k in kinds})


def job_stats(df: DataFrame, file: str = "source_file", ok: str = "ok") -> DataFrame:
    """(file, processed, successful, failed), and a row with a null file for all together."""
    return df.rollup(F.col(file).alias("file")).agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col(ok)).alias("successful"), F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed"))


def repair_quotes(text: str | None) -> str | None:
    """JSON text from a single-quoted dict: as a literal, then by rewriting quotes around names and values, then all quotes; null if none works."""
    if text is None:
        return None
    try:
        return json.dumps(ast.literal_eval(text.strip()))
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        pass
    inner = re.sub(r"(?<=\w)'(?=\w)", "\u0001", text)
    names = re.sub(r"'([^']*)'", lambda m: json.dumps(m.group(1).replace("\u0001", "'")), inner).replace("\u0001", "'")
    for attempt in (names, text.replace("\\'", "\u0001").replace("'", '"').replace("\u0001", "'")):
        try:
            return json.dumps(json.loads(attempt))
        except ValueError:
            continue
    return None

