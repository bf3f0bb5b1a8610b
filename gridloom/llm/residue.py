"""Template residue and error-page text: unfilled slots, values a program printed for nothing, filler, error messages,
notices about scripts, cookies or access.

Lines are normalised and counted by host; lines that recur over a share of a host's documents and hold no evidence
(page links, footers) are subtracted, titles too. What is left is judged: one slot or printed nothing condemns a text;
the other kinds do only if every sentence left is evidence, or goes with it. A text that reports a message keeps
sentences of its own and is left alone.

Evidence is put together, not listed by phrase: a sentence that names a failure; one that denies something a site
offers; one that asks for, or misses, what a browser has (in the languages of WORDS). Filler is what repeats
itself, or says that it is filler. Sentences that go with messages are learned from the data: those that, over several
documents, stand in texts that begin with evidence and hold little else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.skew import salted_join
from gridloom.storage import checkpointed, written

#: A line is boilerplate if this share of a host's documents has it, and at least LEAST of them.
RECURS, LEAST = 0.0005, 3
#: A learned companion: the share of the texts holding it that must be messages otherwise, and how many texts at least.
COMPANION_SHARE, COMPANION_LEAST = 0.9, 3
#: A text repeats itself if it has at most so many distinct words, and so many times as many in all. And the words that
#: may stand between two filler phrases. A word has at most SPELLINGS forms (case, signs around it).
PHRASE_WORDS, PHRASE_TIMES, BETWEEN, SPELLINGS = 8, 3, 3, 8

#: Words of failure that stand alone, and those that end others ("keyerror", "serverfehler"); requests to
#: log in; words that say of a text that it is filler, and how the usual filler begins. Lower case, without accents.
FAILURE = r"(?:fatal|erreurs?|erros?|excepcion|excecao|ausnahme|failures?|traceback|oops|ups|hoppla|went wrong|salio mal|deu errado|schief ?gegangen|mal passee?)\b"
FAILURE_ENDS = ("error", "fehler", "exception", "timeout")
ENTERING = r"(?:(?:sign|log) ?in (?:to|again|before)|inicie sesion|identifiez|connectez|melden sie|faca login|entre com)\b"
FILLER_WORDS = r"(?:filler|dummy|placeholder|sample|example) (?:words?|text|paragraphs?|description|content)\b|text goes here\b|texto de (?:ejemplo|relleno|exemplo|preenchimento)\b|texte (?:de remplissage|d.exemple)\b|(?:blind|beispiel|platzhalter|full)text\b|blah?\b|x{3,}\b|(?:asdf|qwer)\w*"
FILLER_BEGINS = r"lorem ipsum|dolor sit amet|consectetur adipiscing|eiusmod tempor"
#: A word of any of these, at its first letters.
ANY_WORD = rf"\b(?=[abcdefhilmopqstuwx])(?:{FILLER_BEGINS}|{FILLER_WORDS}|{FAILURE}|{ENTERING})"
FILLER = rf"(?:{FILLER_BEGINS})[^.!?\n]*|\b(?=[abdefpstqx])(?:{FILLER_WORDS})"

#: Words of failure, of denial, of what a site offers, of what a browser has and of asking for it, in
#: English, Spanish, French, Portuguese and German, lower case and without accents.
WORDS = {
    "failure": rf"(?:errors?|errores|fehler|exceptions?|timeouts?)\b|\b{FAILURE}",
    "denial": r"\b(?=[abcdefgiklmnoprstuvw])(?:not (?:be )?found|(?:could|can|did|does|do|is|are|was) ?(?:not|n.t)|can.?t|unable|failed|unavailable|denied|forbidden|expired|timed out|disabled|blocks?|blocked|closed|offline|down|too many|moved|deleted|removed|no longer|bad|no (?:se )?(?:pudo|puede|existe|esta)|no (?:fue )?encontrad[oa]|nao (?:foi )?(?:encontrad[oa]|existe|esta|pode)|deneg\w+|negad[oa]|(?:non|pas) (?:ete )?(?:trouvee?s?|disponible)|introuvable|(?:in|no )disponible|indisponivel|n.existe|n.est|refusee?|interdit|nicht|kein|keine|verweigert|gesperrt|abgelaufen|verschoben|geloscht|eliminad[oa]|removid[oa]|movid[oa]|supprimee?|deplacee?)\b",
    "thing": r"\b(?:pages?|site|website|server|service|system|records?|files?|document|sheet|request(?:s|ed)?|session|portal|gateway|access|permission|application|database|store|catalogue|connection|tile|map|viewer|url|content|resource|pagina|sitio|servidor|servicio|servico|registro|ficha|solicitud|sesion|sessao|acceso|acesso|serveur|fiche|demande|acces|seite|dienst|beleg|zugriff|datensatz|anfrage|sitzung|karte|maintenance|mantenimiento|manutencao|wartung)\b",
    "browser": r"\b(?=[abcjnrs])(?:java ?scripts?|scripts?|scripting|cookies?|browser|navegador|navigateur|noscript|robot|captcha|ad ?blocker)\b",
    "asking": r"\b(?:please|enable|activate|allow|accept|turn(?:ed)?|switch(?:ed)?|require[ds]?|needs?|needed|must|disabled|blocks?|blocked|not|depends|verify|confirm|prove|checking|upgrade|update|por favor|activar|active[rz]?|habilit\w+|ativ\w+|aktivieren|permit\w+|acept\w+|accepte[rz]?|bitte|veuillez|requier\w+|necesita\w*|precisa\w*|necessite|benotigt|erforderlich)\b",
    "entering": rf"(?<![a-z] )\b(?:please )?{ENTERING}",
    "code": r"^(?:(?:http|status|error|code|http status)\W*)*[45]\d\d\b(?:\W+\w+){0,3}\W*$|^\s*(?:file|at) \W?[\w.$/<>]+\W.*\bline \d+|^\s*at [\w.$]+\([\w.$]+:\d+\)",
    "going with it": r"^(?:please|try again|retry|reload|refresh|return to|(?:go|come) back|contact|wait|slow down|thank you|loading|reference|code|codigo|fehlercode|this (?:may|can|might) take|if nothing appears|veuillez|bitte|vuelva|intente|reintente|tente|volte|merci|gracias|obrigad[oa]|danke)\b",
}
#: How a sentence tells of something that happened, to somebody or at a time.
TELLING = r"[,;] (?:so|because|until|but|apart|after|donc|weil|pero|mas|which \w+ed)\b|\b(?:she|he|they)\b|\bin (?:1[89]|20)\d\d\b|\b(?:met|stopped|kept|delayed|stayed|queued|counted|wrote|said)\b"
#: Letters with accents and the plain ones.
ACCENTED, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"

#: The shapes of a slot, each with a part it cannot be without. A name is a word, or words joined by
#: dots or underscores; a slot's brackets are doubled, or marked by a sign, or hold a request.
SLOTS = (
    ("{{", r"\{\{\s*[#/^]?\s*[\w.]+(?:\s*\|[^{}]*)?\s*\}\}"), ("[[", r"\[\[\s*[A-Z][A-Z_ ]*\]\]"), ("<<", r"<<\s*\w+\s*>>"), ("@@", r"@@\w+@@"), ("%%", r"%%[A-Za-z]\w*%%"), ("__", r"\b__[A-Z][A-Z_]*__"), ("XX", r"\bXX[A-Z][A-Z_]*XX\b"), ("{", r"[$#@%]\{\s*[\w.]+\s*\}"),
    ("%(", r"%\(\w+\)[sdfi]"), ("#", r"#[A-Z][A-Z_]+#"), ("*|", r"\*\|[A-Z_:]+\|\*"), ("<?", r"(?s)<\?(?!xml).*?\?>"), ("<%", r"(?s)<%.*?%>"), ("{%", r"(?s)\{%\s*\w.*?%\}"), ("{", r"\{(?:\d|[A-Za-z]\w*_\w+|[A-Za-z]{4,})\}"), ("[", r"\[[A-Z]{2,}(?:[_ ][A-Z]{2,})+\]"),
    (":", r"(?<![\w:]):[a-z]+_[a-z_]+\b"), ("[", r"(?i)\[\s*(?:insert|enter|add|type|your|put|fill in|choose|select) [^\[\]]+\]"), ("<", r"(?i)<\s*(?:insert|enter|add|type|your|put|fill in|choose|select) [^<>]+>"), ("[", r"(?i)\[[^\[\]]+ (?:goes )?here\]"), ("<", r"<[A-Z][A-Z_ ]* HERE>"), ("TODO: ", r"\bTODO: (?:add|insert|fill|write)\b"),
)

#: What programs print for nothing, and the words before a value's place.
NOTHING = r"(?:undefined|null|NaN|nil)"
PRINTED = r"\[object Object\]|\bNaN[-_/]NaN\b|\bInvalid Date\b|\b(?:at|by|on|from|in|for|of|depth|[Ss]ee|[Rr]ecords:|[Ss]pecimen|[Cc]ell)\s+" + NOTHING + r"\b(?![\w-])(?! (?:means|is|in the|in column))|(?<![a-z] )\b(?:[Ff]ound in|at|by|on|from|depth) None\b"
PRINTED_PARTS = ("undefined", "null", "NaN", "nil", "None", "[object Object]", "Invalid Date")


def _lines(text: Column) -> Column:
    """The text's lines without markup, trimmed; empty ones left out."""
    bare = F.regexp_replace(text, r"(?i)</?(?:html|head|body|p|br|div|span|h\d|li|ul|table|tr|td|b|i)\b[^<>]*>", "\n")
    bare = F.when(text.contains("<"), bare).otherwise(text)
    plain = F.when(text.contains("&"), F.regexp_replace(F.regexp_replace(bare, "&amp;", "&"), r"&nbsp;", " ")).otherwise(bare)
    return F.filter(F.transform(F.split(plain, r"\n+"), lambda x: F.trim(F.regexp_replace(x, r"[\s ]+", " "))), lambda x: x != "")


def _normal(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), r"\d+", "0")


def _plain(line: Column) -> Column:
    return F.translate(F.lower(line), ACCENTED, PLAIN)


def _is_title(line: Column) -> Column:
    """A heading: a few words with no end of sentence, or a bare code."""
    few = F.size(F.split(line, " ")) <= 7
    return few & ~line.rlike(r"[.!?:;,…]$") & (line.rlike(r"^[^a-z]*[A-Z][\w.]*(?: [\w.]+)? [-–|] \S+(?: \S+)?$") | line.rlike(r"^[A-Z]+:[A-Z0-9]+$") | line.rlike(r"^[A-Z][a-z]+(?: [a-z]+){0,2}$"))


def _is_links(line: Column) -> Column:
    """Words between bars or arrows, or a footer's sign."""
    return line.rlike(r"^\w+(?: \w+)?(?:\s*[|·>]\s*\w+(?: \w+)?)+$|^(?:©|\([cC]\))")


def has_slot(text: Column) -> Column:
    """The text has a slot. A shape is tried only on texts that hold the part it cannot be without."""
    found = F.lit(False)
    for part, shape in SLOTS:
        found = found | (text.contains(part) & text.rlike(shape))
    return found


def has_printed(text: Column) -> Column:
    parts = F.lit(False)
    for p in PRINTED_PARTS:
        parts = parts | text.contains(p)
    return parts & text.rlike(PRINTED)


def repeats_itself(text: Column) -> Column:
    """So few of the words are distinct that the text is one phrase over and over."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # Split at blanks first: a far cheaper count that leaves few texts to look at.
    return (F.size(F.array_distinct(F.split(text, " "))) <= PHRASE_WORDS * SPELLINGS) & F.exists(F.array(words), lambda w: (F.size(w) >= 2 * PHRASE_TIMES) & (F.size(F.array_distinct(w)) <= F.least(F.lit(PHRASE_WORDS), F.size(w) / PHRASE_TIMES)))


def is_evidence(sentence: Column) -> Column:
    """A sentence (lower case, without accents) that is part of a message or a notice."""
    has = lambda name: sentence.rlike(WORDS[name])
    says = has("failure") | (has("denial") & has("thing")) | (has("browser") & has("asking")) | has("entering") | has("code")
    return says & ~sentence.rlike(TELLING)


def may_be_message(text: Column) -> Column:
    """Some sentence of the text could be evidence, or says that it is filler."""
    together = lambda p, one, other: p.rlike(WORDS[one]) & F.exists(F.split(p, r"[.!?\n]"), lambda s: s.rlike(WORDS[one]) & s.rlike(WORDS[other]))
    code = r"(?m)^\W*(?:\w+\W+){0,2}[45]\d\d\b|^\s*(?:file|at) .*\d"
    # Bound by the lambda, the plain text is made once.
    return F.exists(F.array(_plain(text)), lambda p: p.rlike(ANY_WORD) | reduce(lambda x, y: x | y, [p.contains(w) for w in FAILURE_ENDS]) | p.rlike(code) | together(p, "browser", "asking") | together(p, "denial", "thing"))


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", recurs: float = RECURS) -> DataFrame:
    """(doc_id, kind): each document that holds residue, once; kind is "slot", "printed" or "message" (the first that holds).

    Whole texts and lines are read, however long. Null, empty and blank texts hold none. Rows repeated with one id give it
    once. A null host is a host of its own. A text of boilerplate lines alone is no case: it has no evidence. Extra columns
    are not read.
    """
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("h")).where(F.col("t").isNotNull())
    # One pass over the texts keeps the lines of those with anything that could be evidence; all judgement is on these.
    marked = d.select("id", "h", "t", has_slot(F.col("t")).alias("slot"), has_printed(F.col("t")).alias("printed"), repeats_itself(F.col("t")).alias("filler"), may_be_message(F.col("t")).alias("suspect"))
    marked = marked.where(F.col("slot") | F.col("printed") | F.col("filler") | F.col("suspect"))
    kept = marked.select("id", "h", "filler", F.posexplode(_lines(F.col("t"))).alias("pos", "line"))
    lines, _ = written(kept.select("*", _plain(F.col("line")).alias("plain"), _plain(F.col("line")).rlike(FILLER).alias("says")), "suspect-lines")
    if lines.isEmpty():
        return lines.select(F.col("id").alias(doc_id), F.lit("").alias("kind"))

    # Lines by host: sent as hashes, counted before they are sent, kept only where they recur.
    hashed = d.select("id", "h", F.explode(F.array_distinct(F.transform(_lines(F.col("t")), lambda x: F.xxhash64(_normal(x))))).alias("norm"))
    counted = hashed.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    hosts = d.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"))
    recurrent = counted.join(hosts, "h").where(F.col("n") >= F.lit(recurs) * F.col("n_docs")).select("h", "norm", F.lit(True).alias("recurrent"))
    joined = salted_join(lines.withColumn("norm", F.xxhash64(_normal(F.col("line")))), recurrent, ["h", "norm"], "left")

    # Filler phrases and the few words between them are taken out first; what is left of a line is split into sentences.
    bare = F.when(F.col("says"), F.regexp_replace("plain", f"(?:{FILLER})", " \x02 ")).otherwise(F.col("plain"))
    sentences = F.transform(F.split(bare, r"(?<=[.!?])\s+|\x02|\s:\s"), lambda s: F.trim(s))
    sentences = F.filter(sentences, lambda s: s.rlike(r"\w") & ~(F.col("says") & (F.size(F.split(s, " ")) <= BETWEEN)))
    parts = F.transform(sentences, lambda s: F.struct(s.alias("s"), is_evidence(s).alias("e")))
    # Written before it is used: each use would judge the sentences anew.
    judged = checkpointed(joined.select("id", "h", "pos", "filler", "recurrent", "says", has_slot(F.col("line")).alias("slot"), has_printed(F.col("line")).alias("printed"), (_is_title(F.col("line")) | _is_links(F.col("line"))).alias("heading"), parts.alias("parts")))
    evident = F.col("slot") | F.col("printed") | F.col("says") | F.exists("parts", lambda p: p["e"])
    residual = judged.withColumn("evident", evident).where(F.col("evident") | ~(F.coalesce("recurrent", F.lit(False)) | F.col("heading")))

    flat = residual.select("id", "h", "pos", F.posexplode("parts").alias("at", "p")).select("id", "h", "pos", "at", F.regexp_replace("p.s", r"\d+", "0").alias("s"), F.coalesce("p.e", F.lit(False)).alias("e"))
    first = F.min(F.struct("pos", "at", "e"))["e"]
    texts = flat.where(F.col("s").isNotNull()).groupBy("id").agg(first.alias("begins"), F.count(F.lit(1)).alias("n"), F.sum((~F.col("e")).cast("int")).alias("open"))
    candidates = flat.where(F.col("s").isNotNull() & ~F.col("e")).select("id", "s").distinct().join(texts, "id")
    like = F.col("begins") & (F.col("open") <= 2)
    learned = candidates.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum(like.cast("int")).alias("k")).where((F.col("n") >= COMPANION_LEAST) & (F.col("k") >= COMPANION_SHARE * F.col("n"))).select("s", F.lit(True).alias("learned"))
    open_parts = salted_join(flat.where(F.col("s").isNotNull() & ~F.col("e")), learned, ["s"], "left")
    own = open_parts.where(~(F.coalesce("learned", F.lit(False)) | F.col("s").rlike(WORDS["going with it"]))).select("id").distinct().withColumn("own", F.lit(True))
    verdict = residual.groupBy("id").agg(F.bool_or("slot").alias("slot"), F.bool_or("printed").alias("printed"), F.bool_or("filler").alias("filler"), F.bool_or(F.col("says") | F.exists("parts", lambda p: p["e"])).alias("core"))
    verdict = verdict.join(own, "id", "left")
    kind = F.when(F.col("slot"), "slot").when(F.col("printed"), "printed").when(F.col("filler") | F.col("core") & F.col("own").isNull(), "message")
    return verdict.select(F.col("id").alias(doc_id), kind.alias("kind")).where(F.col("kind").isNotNull())
