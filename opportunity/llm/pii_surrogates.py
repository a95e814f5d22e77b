"""Keyed surrogates for personal data, with DataFrame functions only.

Entities are e-mail addresses, secrets in hex, IPv4 addresses, IBANs, phone numbers, card
numbers, social security numbers, and names after forms of address or an introduction ("my name
is", "signed by", "Dear" and the like). A name has one to five words (two at least after a mere
introduction) with hyphens, apostrophes, initials and particles such as "van" and "de"; words that
letters put after such cues without naming anyone ("Dear Customer Service") end it. Where the whole
name or its family name stands again in the same document, with or without a cue, it is replaced
too. Each entity gets a surrogate that depends on a key, its kind and its normal form alone, so it
reads alike everywhere (coreference), in whatever format it is written:

* marks, spaces and the number and case of characters stay; digits become digits, letters letters;
* phone numbers keep their country code, card numbers their first digit and whether their check
  digit is right, addresses the size of their parts, IBANs their country, e-mails the top level;
* e-mails of one domain keep one domain, and those of different domains different ones;
* names keep what stands before them, the gender that it tells (if it does), their script (Latin,
  Cyrillic, Greek), capitals, hyphens, particles and prefixes such as O', and initials stay initials.

Distinct entities must stay distinct, and a surrogate must not be another entity of the corpus.
All entities, the domains of e-mails among them, are checked for that in one aggregate and one
join; those that collide, but for the first of each group, are drawn again. Every further attempt
draws from a larger space where the format leaves room: family names grow by a syllable, and from
the third attempt on the parts of an address may change size. What still collides after
``ROUNDS`` attempts, which takes as many distinct entities as their format has forms, is written
as ``<KIND-16 hex digits>``. Only the exceptions, few or none, are joined back to documents.

Null texts stay null, empty ones empty. Rows with the same doc_id, or none, are replaced by their
own texts: exceptions go by doc_id and a hash of the text. Overlapping patterns are matched from the left, in the order above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opportunity.llm.common import broadcast_if_light, broadcast_if_small, partitions, written

ROUNDS = 12
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sir", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Dame", "Госпожа", "Κυρία")
#: Forms of address that tell no gender.
NEUTRAL = ("[Dd]octor", "Dr", "[Pp]rofessor", "Prof")
#: What introduces a name without being a form of address.
CUES = (
    "[Mm]y name is", "[Nn]ame:", "[Ss]igned by", "[Ww]ritten by", "[Aa]uthor:", "[Cc]ontact:", "[Aa]ttn:", "Dear", "Sincerely,", "Regards,",
    "[Mm]ein Name ist", "[Ii]ch heiße", "[Jj]e m'appelle", "[Mm]on nom est", "[Mm]e llamo", "[Mm]i nombre es",
    "[Мм]еня зовут", "[Μμ]ε λένε",
)
#: Words of a name that are written small and stay.
PARTICLES = ("van", "von", "de", "da", "di", "del", "della", "der", "den", "dos", "du", "la", "le", "ter", "ten", "zu", "zur", "bin", "ibn", "al")
#: Capitalised words that are no part of a name after a cue.
NO_NAMES = (
    "Customers?", "Clients?", "Sirs?", "Madams?", "Team", "All", "Everyone", "Friends?", "Colleagues?", "Members?", "Service", "Support", "Readers?", "Users?", "Editors?",
    "Hiring", "Managers?", "Valued", "Parents?", "Students?", "Applicants?", "Candidates?", "Subscribers?", "Guests?", "Committee", "Department", "Office", "Board",
    "The", "This", "That", "These", "Those", "And", "But", "He", "She", "It", "We", "You", "They", "His", "Her", "Our", "Your", "My", "I", "A", "An", "In", "On", "At", "As", "If",
    "For", "From", "To", "With", "When", "Please", "Thanks?", "Phone", "Tel", "Telephone", "Mobile", "Email", "E-mail", "Mail", "Fax", "Address", "Date", "Subject", "Best", "Kind",
    "Regards", "Sincerely", "Dear", "Contact", "Name", "Author", "Call", "Card", "Account", "IBAN", "IP", "SSN",
)
TITLES = "|".join(sorted(MALE + FEMALE, key=len, reverse=True) + list(NEUTRAL))
START, STOP = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{M}\p{N}@_])"
LETTERS = r"[\p{L}\p{M}]*+"
WORD = rf"(?!(?:{'|'.join(NO_NAMES)}|{TITLES}){STOP})(?:(?:\p{{Lu}}\.)++(?= )|\p{{Lu}}{LETTERS}(?:['’]\p{{Lu}}{LETTERS}|-\p{{L}}{LETTERS})*+{STOP})"
PARTS = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b",
    "secret": r"\b[0-9A-Fa-f]{32,64}\b",
    "ip": rf"\b{OCTET}(?:\.{OCTET}){{3}}\b(?!\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}(?:[ .-]?\d{2,4}){1,2}\b|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b",
    "card": r"\b\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "name": rf"{START}(?:(?:(?:{'|'.join(CUES)})\.? )?(?:(?:{TITLES})\.? )++{PARTS}{WORD}(?: {PARTS}{WORD}){{0,4}}|(?:{'|'.join(CUES)})\.? {WORD}(?: {PARTS}{WORD}){{1,4}})",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every text with an entity has; the others are not searched further.
GATE = rf"[0-9@]|(?:{TITLES}|{'|'.join(CUES)})\.? \p{{L}}"
#: The part of a name's match before the name itself.
BEFORE = rf"^(?:(?:{TITLES}|{'|'.join(CUES)})\.? )+"
SYLLABLES = {
    "latin": ("ba", "co", "de", "fi", "ga", "hu", "jo", "ka", "le", "mi", "no", "pe", "ra", "si", "ta", "vo"),
    "cyrillic": ("ба", "во", "ге", "ди", "жа", "зу", "ки", "ла", "ме", "ни", "по", "ра", "се", "та", "фи", "ша"),
    "greek": ("βα", "γο", "δε", "ζι", "θα", "κυ", "λο", "μα", "νε", "ξι", "πο", "ρα", "σε", "τι", "φα", "χο"),
}
ENDINGS = {
    "latin": {"any": ("en", "is", "or", "y"), "male": ("n", "r", "s", "l"), "female": ("a", "ia", "na", "lla"), "family": ("man", "sen", "ler", "ton")},
    "cyrillic": {"any": ("и", "о", "е", "ю"), "male": ("н", "р", "м", "л"), "female": ("я", "на", "ла", "ша"), "family": ("ко", "енко", "ых", "ук")},
    "greek": {"any": ("ι", "υ", "ε", "ω"), "male": ("ς", "ος", "ης", "ων"), "female": ("α", "η", "ία", "ώ"), "family": ("ίδη", "άκη", "έα", "ού")},
}


def entities(text: Column) -> Column:
    """All matches of a text in order, second mentions of names left out."""
    return F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(F.array().cast("array<string>"))


def bare(match: Column) -> Column:
    """A name without what stands before it."""
    return F.regexp_replace(match, BEFORE, "")


def family(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def mentions(docs: DataFrame) -> DataFrame:
    """``docs`` (_text and more) with _pattern, and _found: the matches in order, each with the entity that it is a mention ``of``."""
    named = docs.withColumn("_cued", entities(F.col("_text"))).withColumn("_named", F.filter("_cued", lambda match: match.rlike(BEFORE)))
    whole = F.transform("_named", bare)
    known = F.filter(F.array_distinct(F.concat(whole, F.transform(whole, family))), lambda name: F.length(name) > 1)
    # The longest first, so that a family name does not cut a whole one short.
    known = F.array_sort(known, lambda x, y: F.length(y) - F.length(x))
    again = F.concat(F.lit(rf"{ENTITY}|{START}(?:\Q"), F.array_join(known, r"\E|\Q"), F.lit(rf"\E){STOP}"))
    found = named.withColumn("_pattern", F.when(F.size("_named") > 0, again).otherwise(F.lit(ENTITY)))
    found = found.withColumn("_found", F.when(F.size("_named") > 0, F.regexp_extract_all("_text", F.col("_pattern"), F.lit(0))).otherwise(F.col("_cued")))

    def of(match: Column) -> Column:
        first = F.get(F.filter("_named", lambda entity: bare(entity) == match), F.lit(0))
        return F.coalesce(first, F.get(F.filter("_named", lambda entity: family(entity) == match), F.lit(0)), match)

    return found.withColumn("_found", F.transform("_found", lambda match: F.struct(match.alias("match"), of(match).alias("of"))))


def kind_of(match: Column) -> Column:
    """Which pattern a match fits."""
    kind = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())):
        kind = F.when(match.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def normal_form(kind: Column, match: Column) -> Column:
    """What two writings of one entity share."""
    plain = F.regexp_replace(match, r"[^0-9A-Za-z+]", "")
    # A single word is a family name, which every gender shares.
    name = F.when(bare(match).contains(" "), F.concat(gender(match), F.lit(" "), bare(match))).otherwise(bare(match))
    return F.when(kind.isin("email", "secret"), F.lower(match)).when(kind == "ip", match).when(kind == "name", name).otherwise(plain)


def gender(match: Column) -> Column:
    """What the forms of address before a name tell: male, female or any."""
    before = F.regexp_extract(match, BEFORE, 0)

    def told(titles: tuple[str, ...]) -> Column:
        return before.rlike(rf"(?:^| )(?:{'|'.join(titles)})\.? ")

    return F.when(told(MALE), F.lit("male")).when(told(FEMALE), F.lit("female")).otherwise(F.lit("any"))


def _digest(key: str, *parts: Column) -> Column:
    """128 hex digits that depend on the key and the parts."""
    text = F.concat_ws("|", F.lit(key), *parts)
    return F.concat(F.sha2(text, 256), F.sha2(F.concat(F.lit("2|"), text), 256))


def _number(digest: Column, place: Column, width: int = 4) -> Column:
    # Steps of 3 visit all places before one comes again.
    return F.conv(F.substring(digest, F.pmod(place * 3, F.lit(128 - width)) + 1, F.lit(width)), 16, 10).cast("int")


def _pick(choices: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), F.pmod(number, F.lit(len(choices))) + 1)


def _like(match: Column, digest: Column, fixed: Column, hex_digits: Column | None = None) -> Column:
    """Digits for digits and letters for letters, but for the first ``fixed`` characters."""

    def one(i: Column) -> Column:
        char = F.substring(match, i, F.lit(1))
        # Counted without marks, so that other formats of the same entity get the same characters.
        place = F.length(F.regexp_replace(F.substring(match, F.lit(1), i), "[^0-9A-Za-z]", ""))

        def drawn(number: Column) -> Column:
            letter = F.chr(F.pmod(number, F.lit(26)) + F.when(char.rlike("[A-Z]"), 65).otherwise(97))
            new = F.when(char.rlike("[0-9]"), F.pmod(number, F.lit(10)).cast("string")).when(char.rlike("[A-Za-z]"), letter).otherwise(char)
            if hex_digits is not None:
                digit = F.substring(F.lit("0123456789abcdef"), F.pmod(number, F.lit(16)) + 1, F.lit(1))
                new = F.when(hex_digits, F.when(match.rlike("[A-F]"), F.upper(digit)).otherwise(digit)).otherwise(new)
            return new

        return F.when(i <= fixed, char).otherwise(_let(_number(digest, place), drawn))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(match)), one), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of a number's digits, every second one from the right doubled, modulo 10."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _card(match: Column, digest: Column) -> Column:
    new = _like(match, digest, F.lit(1))
    body = F.substring(new, F.lit(1), F.length(new) - 1)
    digits = F.regexp_replace(body, "[^0-9]", "")
    check = ((10 - luhn_sum(F.concat(digits, F.lit("0")))) % 10).cast("string")
    return F.when(luhn_sum(F.regexp_replace(match, "[^0-9]", "")) == 0, F.concat(body, check)).otherwise(new)


def _address(match: Column, digest: Column, attempt: Column) -> Column:
    def part(octet: Column, i: Column) -> Column:
        number = _number(digest, i)
        low = F.when(F.length(octet) == 1, 1).when(F.length(octet) == 2, 10).otherwise(100)
        span = F.when(F.length(octet) == 1, 9).when(F.length(octet) == 2, 90).otherwise(156)
        return F.when(attempt > 2, 1 + F.pmod(number, F.lit(255))).otherwise(low + F.pmod(number, span)).cast("string")

    return F.array_join(F.transform(F.split(match, r"\."), part), ".")


def _domain(domain: Column, attempt: Column, key: str) -> Column:
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    new = _let(_digest(key, F.lit("domain"), F.lower(domain), attempt.cast("string")), lambda shared: _like(host, shared, F.lit(0)))
    # A short host has few forms: later attempts add letters.
    longer = F.substring(F.translate(_digest(key, F.lit("more"), F.lower(domain), attempt.cast("string")), "0123456789", "ghijklmnop"), F.lit(1), F.greatest(F.lit(0), attempt))
    return F.concat(new, longer, F.lit("."), top)


def _email(match: Column, digest: Column, key: str, domain_attempt: Column) -> Column:
    local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    return F.concat(_like(local, digest, F.lit(0)), F.lit("@"), _domain(domain, domain_attempt, key))


def _syllables(count: Column, digest: Column, known: tuple[str, ...]) -> Column:
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda k: _pick(known, _number(digest, 4 + k))), "")


def _name(match: Column, attempt: Column, key: str) -> Column:
    """Word by word, so that a family name reads alike with and without a given name."""
    before = F.regexp_extract(match, BEFORE, 0)
    words = F.split(bare(match), " ")
    script = F.when(match.rlike(r"\p{IsCyrillic}+(?: |$)"), F.lit("cyrillic")).when(match.rlike(r"\p{IsGreek}+(?: |$)"), F.lit("greek")).otherwise(F.lit("latin"))

    def spelled(role: Column, digest: Column) -> Column:
        made = None
        for name, syllables in SYLLABLES.items():
            stem = F.concat(_pick(syllables, _number(digest, F.lit(1))), _pick(syllables, _number(digest, F.lit(2))))
            third = F.when(role == "family", _pick(syllables, _number(digest, F.lit(3)))).otherwise(F.lit(""))
            more = _syllables(F.when((role == "family") & (attempt > 0), attempt).otherwise(0), digest, syllables)
            end = F.lit("")
            for kind, endings in ENDINGS[name].items():
                end = F.when(role == kind, _pick(endings, _number(digest, F.lit(4)))).otherwise(end)
            whole = F.initcap(F.concat(stem, third, more, end))
            made = whole if made is None else F.when(script == name, whole).otherwise(made)
        return made

    def initial(number: Column) -> Column:
        made = None
        for name, syllables in SYLLABLES.items():
            letter = F.upper(F.substring(_pick(syllables, number), 1, 1))
            made = letter if made is None else F.when(script == name, letter).otherwise(made)
        return made

    def initials(w: Column, digest: Column) -> Column:
        letters = F.split(F.regexp_replace(w, r"\.", ""), "")
        mark = F.when(w.endswith("."), F.lit(".")).otherwise(F.lit(""))
        return F.array_join(F.transform(letters, lambda _, k: F.concat(initial(_number(digest, k)), mark)), "")

    def part(w: Column, role: Column) -> Column:
        prefix = F.regexp_extract(w, r"^\p{Lu}['’](?=\p{Lu})", 0)

        def drawn(digest: Column) -> Column:
            new = spelled(role, digest)
            return F.concat(prefix, F.when((F.upper(w) == w) & (F.lower(w) != w), F.upper(new)).otherwise(new))

        return _let(_digest(key, F.lit("word"), role, F.initcap(w), attempt.cast("string")), drawn)

    def word(w: Column, i: Column) -> Column:
        role = F.when(i == F.size(words) - 1, F.lit("family")).otherwise(gender(match))
        short = _let(_digest(key, F.lit("initial"), w, attempt.cast("string")), lambda digest: initials(w, digest))
        long = F.array_join(F.transform(F.split(w, "-"), lambda p: part(p, role)), "-")
        return F.when(w.isin(*PARTICLES), w).when(w.rlike(r"^(?:\p{Lu}|(?:\p{Lu}\.)+)$"), short).otherwise(long)

    return F.concat(before, F.array_join(F.transform(words, word), " "))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def surrogate(match: Column, attempt: Column, key: str, domain_attempt: Column | None = None) -> Column:
    """The surrogate of one match; attempt 0 at first, -1 for the plain form. ``domain_attempt`` is that of an e-mail's domain."""
    domain_attempt = F.lit(0) if domain_attempt is None else domain_attempt

    def drawn(kind: Column, digest: Column) -> Column:
        country = F.length(F.regexp_extract(match, r"^\+\d{1,3}(?=[ .(-])", 0))
        fixed = F.when(kind == "iban", 2).when(kind == "phone", country).otherwise(0)
        plain = F.concat(F.lit("<"), F.upper(kind), F.lit("-"), F.substring(digest, 1, 16), F.lit(">"))
        found = F.when(attempt < 0, plain).when(kind == "email", _email(match, digest, key, domain_attempt)).when(kind == "ip", _address(match, digest, attempt))
        found = found.when(kind == "card", _card(match, digest)).when(kind == "name", _name(match, attempt, key))
        return found.otherwise(_let(fixed, lambda n: _like(match, digest, n, kind == "secret")))

    def keyed(kind: Column) -> Column:
        return _let(_digest(key, kind, normal_form(kind, match), attempt.cast("string")), lambda digest: drawn(kind, digest))

    return _let(kind_of(match), keyed)


def domain_of(match: Column) -> Column:
    return F.lower(F.substring_index(match, "@", -1))


def occurrences(docs: DataFrame) -> DataFrame:
    """_id, _tie (a hash of the text), kind, normal and match of every entity of ``docs`` (doc_id, text), the domains of e-mails among them."""
    found = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tie"), F.explode(entities(F.col("text"))).alias("match"))
    found = found.withColumn("kind", kind_of(F.col("match"))).withColumn("normal", normal_form(F.col("kind"), F.col("match")))
    own = F.array(F.struct("kind", "normal", "match"), F.when(F.col("kind") == "email", F.struct(F.lit("domain").alias("kind"), domain_of(F.col("match")).alias("normal"), domain_of(F.col("match")).alias("match"))))
    return written(found.select("_id", "_tie", F.explode(F.array_compact(own)).alias("e")).select("_id", "_tie", "e.*"), "occurrences")


def collisions(found: DataFrame, key: str) -> DataFrame:
    """normal, kind and attempt of the entities among ``found`` (kind, normal, match) that need another attempt than 0."""
    known = written(found.groupBy("kind", "normal").agg(F.min("match").alias("match")).withColumn("attempt", F.lit(0)), "entities")
    settled = known
    for turn in range(1, ROUNDS + 2):
        # Few bytes, but much work on each of them.
        drawn = settled.repartition(partitions(found.sparkSession), "kind", "normal")
        new = F.when((F.col("kind") == "domain") & (F.col("attempt") >= 0), _domain(F.col("match"), F.col("attempt"), key)).otherwise(surrogate(F.col("match"), F.col("attempt"), key))
        drawn = drawn.withColumn("new", new)
        drawn = drawn.withColumn("new", F.when((F.col("attempt") < 0) | (F.col("kind") == "domain"), F.col("new")).otherwise(normal_form(F.col("kind"), F.col("new"))))
        taken = known.select("kind", F.col("normal").alias("new"), F.lit(True).alias("real"))
        # An earlier attempt goes first, so settled entities stay.
        order = Window.partitionBy("kind", "new").orderBy(F.abs("attempt"), "normal")
        judged = drawn.join(taken, ["kind", "new"], "left").withColumn("again", F.col("real").isNotNull() | (F.row_number().over(order) > 1))
        # A domain has longer forms with every attempt, so it never needs the plain one.
        last = F.when(F.col("kind") == "domain", F.lit(turn)).otherwise(F.lit(turn if turn <= ROUNDS else -1))
        again = F.when(F.col("again") & (F.col("attempt") >= 0), last).otherwise(F.col("attempt"))
        judged = written(judged.select("kind", "normal", "match", again.alias("attempt"), (F.col("again") & (F.col("attempt") >= 0)).alias("moved")), "entities")
        settled = judged.drop("moved")
        if judged.filter("moved").isEmpty():
            break
    return settled.filter("attempt <> 0").select("kind", "normal", "attempt")


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (doc_id, text and more) with surrogates in ``text``, and n_entities and kinds beside it.

    Columns of ``docs`` that are named n_entities or kinds give way to the new ones.
    """
    known = occurrences(docs)
    exceptions = written(collisions(known, key), "pii-exceptions")
    source = mentions(docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text")))
    if exceptions.isEmpty():
        attempt = domain_attempt = lambda match: F.lit(0)
    else:
        entry = F.struct(F.concat_ws("|", "kind", "normal").alias("key"), F.col("attempt").alias("value"))
        odd = known.join(broadcast_if_small(exceptions), ["kind", "normal"]).groupBy("_id", "_tie").agg(F.map_from_entries(F.collect_set(entry)).alias("_attempts"))
        odd = odd.select(F.col("_id").alias("_odd"), F.col("_tie").alias("_odd_tie"), "_attempts", F.to_json("_attempts").alias("_held"))
        odd = broadcast_if_light(written(odd, "pii-odd"), "_held").drop("_held")
        source = source.join(odd, F.col("_id").eqNullSafe(F.col("_odd")) & (F.xxhash64("_text") == F.col("_odd_tie")), "left")

        def attempt(match: Column) -> Column:
            own = F.concat_ws("|", kind_of(match), normal_form(kind_of(match), match))
            return F.coalesce(F.try_element_at("_attempts", own), F.lit(0))

        def domain_attempt(match: Column) -> Column:
            return F.coalesce(F.try_element_at("_attempts", F.concat(F.lit("domain|"), domain_of(match))), F.lit(0))

    def mention(found: Column) -> Column:
        def told(new: Column) -> Column:
            name = F.when(found.match == bare(found.of), bare(new)).otherwise(family(bare(new)))
            return F.when(found.match == found.of, new).otherwise(name)

        return _let(surrogate(found.of, attempt(found.of), key, domain_attempt(found.of)), told)

    pieces = F.split(F.col("_text"), F.col("_pattern"), -1)
    whole = F.array_join(F.zip_with(pieces, F.transform("_found", mention), lambda piece, s: F.concat(piece, F.coalesce(s, F.lit("")))), "")
    text = F.when(F.size("_found") > 0, whole).otherwise(F.col("_text"))
    kinds = F.array_sort(F.array_distinct(F.transform("_found", lambda found: kind_of(found.of))))
    columns = [text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_entities", "kinds")]
    return source.select(*columns, F.size("_found").cast("long").alias("n_entities"), kinds.alias("kinds"))
