"""Personal data replaced by keyed surrogates, in DataFrame functions only.

An entity is found by its form, brought to a canonical text (digits of a number, lower
case of an address), and its surrogate is drawn from a keyed digest of type and canonical
text: the same person or number has the same surrogate everywhere, in whatever format it
is written, and without the key nothing leads back.  Surrogates keep the type and the
format: letters stay letters of their case, digits digits, separators and country codes
stay, card numbers that pass the Luhn check pass it again, given names keep script and, where
a list or a title tells it, gender.  A person is known by the last name; every name before it
has a surrogate of its own.

Two entities must not share a surrogate and a surrogate must not be another real entity.
All distinct entities are checked for that; those that clash draw again, with a number of
the attempt in the digest, until none is left.  With the attempts surrogates grow longer
(an address moves to a larger range), so that there is room however many entities there are.

Patterns keep no more of a text in mind than a bounded number of labels, names or titles,
so a text of any length and form is read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.runtime import written

#: Given names by script and gender; a surrogate is another name of the same list.
NAMES = {
    ("latin", "f"): "Anna Maria Julia Laura Sarah Emma Sophie Claire Lucia Elena Carmen Ingrid Alice Helen Ruth Nora".split(),
    ("latin", "m"): "John Peter Paul Thomas Michael David Robert Martin Hans Pierre Carlos Miguel James Henry Oscar Felix".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Πέτρος".split(),
}
#: Syllables of surnames by script.
SYLLABLES = {
    "latin": "bar ben dal der fen gar hal ker lan mar nor pel ran sol tan wer".split(),
    "cyrillic": "бор вал гор дан зор кар лен мар нов пет рад сол тар ван яр мил".split(),
    "greek": "βαρ γαλ δελ ζαν καρ λεν μαρ νικ παλ ραν σολ ταρ φιλ χαρ μπελ ρου".split(),
}
FEMALE, MALE = "Mrs Ms Miss Frau Señora Madame Mme Mlle".split(), "Mr Herr Señor Monsieur".split()
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame Mme Mlle".split()

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,}"
ADDRESS = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What may part groups of a phone number: no space before an address.
PART = rf"(?:[.-]| (?!(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])))"
#: +1 has ten digits after it; elsewhere a last group after a space is not the start of a fraction.
PHONE = (rf"\+1(?:{PART}?\([0-9]{{3}}\)|{PART}?[0-9]{{3}}){PART}?[0-9]{{3}}{PART}?[0-9]{{4}}(?![0-9])"
         rf"|\+[0-9]{{1,3}}{PART}?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})(?:{PART}?[0-9]{{2,4}}){{2}}"
         rf"(?:[.-]?[0-9]{{2,4}}|{PART}[0-9]{{2,4}}(?!\.?[0-9]))?(?![0-9])"
         r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])")
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![A-Za-z0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"
GIVEN = "|".join(name for names in NAMES.values() for name in names)
TITLED = rf"(?:(?:{'|'.join(TITLES)})\.? )"
#: A name as it is written (McDonald, O'Neill, Smith-Jones), and with particles or initials before it.
WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}++(?:\p{Lu}\p{Ll}++)*+"
NAME = rf"(?!{TITLED}){WORD}(?:-{WORD})*+"
LAST = rf"(?:\p{{Lu}}\. ){{0,2}}(?:(?:van|von|de|del|della|di|da|dos|du|zu|ter|ten|bin)(?: (?:la|las|los|der|den|het))? )?{NAME}"
#: Up to four names after a title; a listed given name, others of them, and up to three names.
PERSON = (rf"(?<![\p{{L}}])(?:{TITLED}{{1,4}}{LAST}(?: {LAST}){{0,3}}"
          rf"|(?:{GIVEN})(?:[ -](?:{GIVEN})){{0,15}} {LAST}(?: (?!(?:{GIVEN}) \p{{Lu}}){LAST}){{0,2}})(?!\p{{L}})")

#: In order: what an earlier one takes a later one doesn't see.
TYPES = {"email": EMAIL, "ip": ADDRESS, "phone": PHONE, "ssn": SOCIAL, "iban": ACCOUNT, "card": CARD, "secret": SECRET, "person": PERSON}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())

KEY = "replace this key"
#: Rounds of drawing; even 2^32 surnames are apart after a dozen.
MOST_ATTEMPTS = 64


def of_type(entity: Column) -> Column:
    """The type of a text the whole pattern has matched."""
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    found = F.when(F.contains(entity, F.lit("@")), "email")
    for name in ("ip", "phone", "ssn", "card", "secret", "iban"):
        found = found.when(whole(TYPES[name]), name)
    return found.otherwise("person")


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def country(entity: Column) -> Column:
    """Country code of a phone number: one digit for +1, else two; 1 where none is written."""
    return F.when(entity.startswith("+1") | ~entity.startswith("+"), F.lit("1")).otherwise(F.substring(only_digits(entity), 1, 2))


def surname(entity: Column) -> Column:
    return F.regexp_extract(entity, r"([^ ]+)$", 1)


def canonical(kind: Column, entity: Column) -> Column:
    digits = only_digits(entity)
    rest = F.when(entity.startswith("+"), F.substring(digits, F.length(country(entity)) + 1, F.lit(40))).otherwise(digits)
    return (F.when(kind == "phone", F.concat(country(entity), F.lit("|"), rest))
            .when(kind.isin("card", "ssn"), digits)
            .when(kind == "iban", F.regexp_replace(entity, " ", ""))
            .when(kind == "person", F.lower(surname(entity)))
            .when(kind == "ip", entity).otherwise(F.lower(entity)))


def digest(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """Hex digits enough for the longest entity, keyed by a hash within a hash."""
    inner = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string")), 256)
    return F.repeat(F.sha2(F.concat(F.lit(key), inner), 512), 3)


#: Two-digit numbers in a digest.
PLACES = 192


def number(hex_: Column, at: Column | int, of: int) -> Column:
    """A number below ``of`` from two hex digits of the digest."""
    at = F.lit(at % PLACES) if isinstance(at, int) else at % PLACES
    return (F.conv(F.substring(hex_, 2 * at + 1, F.lit(2)), 16, 10).cast("int") % of).cast("int")


def each_character(text: Column, change) -> Column:
    """``text`` with every character at place k (from 0) changed to ``change(character, k)``."""
    places = F.sequence(F.lit(1), F.length(text))
    return F.when(F.length(text) == 0, text).otherwise(
        F.array_join(F.transform(places, lambda k: change(F.substring(text, k, F.lit(1)), k - 1)), ""))


def masked(text: Column, hex_: Column) -> Column:
    """Digits to digits, small letters to small letters, capitals to capitals."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")

    def change(c, k):
        letter = F.substring(letters, number(hex_, k, 26) + 1, F.lit(1))
        return (F.when(c.rlike("[0-9]"), number(hex_, k, 10).cast("string")).when(c.rlike("[a-z]"), letter)
                .when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c))

    return each_character(text, change)


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def syllables(text: Column, hex_: Column, count: int | Column) -> Column:
    """The first syllables a digest draws, in the script of ``text``."""
    script = script_of(text)
    listed = {name: F.array(*map(F.lit, found)) for name, found in SYLLABLES.items()}
    chosen = F.when(script == "cyrillic", listed["cyrillic"]).when(script == "greek", listed["greek"]).otherwise(listed["latin"])
    last = F.lit(count - 1) if isinstance(count, int) else count - 1
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.get(chosen, number(hex_, k, 16)))


def drawn(kind: Column, value: Column, hex_: Column, attempt: Column) -> Column:
    """The canonical text of the surrogate of a canonical text, from its digest.

    A surname is four syllables and one more for each attempt.  An address that can't have
    one of its own range after two attempts moves to 10.x, later to a public one.  The
    others have digits or letters put on from the fourth attempt.
    """
    rest = F.substring_index(value, "|", -1)
    over = F.greatest(attempt - 3, F.lit(0))
    more = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(over, F.lit(1)) - 1), lambda k: number(hex_, k + 100, 10).cast("string")), "")
    more = F.when(over > 0, more).otherwise("")
    # No leading zero where a number must not start with one.
    new = masked(rest, hex_)
    phone = F.concat(F.substring_index(value, "|", 1), F.lit("|"), (number(hex_, 60, 8) + 2).cast("string"), F.substring(new, F.lit(2), F.length(new)))
    local = F.regexp_extract(value, r"^(.*)\.[^.]*$", 1)
    email = F.concat(masked(F.substring_index(local, "@", 1), hex_), more, F.lit("@"), masked(F.substring_index(local, "@", -1), F.reverse(hex_)),
                     F.regexp_extract(value, r"(\.[^.]*)$", 1))
    octet = lambda k: (number(hex_, k, 254) + 1).cast("string")
    private = F.regexp_extract(value, r"^(10|127|192\.168)\.", 1)
    range_ = F.when(attempt > 5, "").when((private != "") & (attempt > 2), "10").otherwise(private)
    inside = F.concat_ws(".", range_, F.when(range_ != "192.168", octet(1)), octet(2), octet(3))
    ip = F.when(range_ != "", inside).otherwise(F.concat_ws(".", (number(hex_, 0, 90) + 130).cast("string"), octet(1), octet(2), octet(3)))
    body = F.concat(F.substring(value, 1, 1), F.substring(masked(value, hex_), F.lit(2), F.length(value) - 2))
    check = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))),
                                  lambda c: F.call_function("luhn_check", c)), 1)
    card = F.when(F.call_function("luhn_check", value), check).otherwise(F.concat(body, number(hex_, 63, 10).cast("string")))
    iban = F.concat(F.substring(value, 1, 2), F.substring(masked(value, hex_), F.lit(3), F.length(value)))
    secret = F.substring(hex_, F.lit(1), F.length(value))
    parts = syllables(value, hex_, attempt.cast("int") + 4)
    person = F.concat(F.array_join(F.slice(parts, 1, 2), ""), F.when(F.contains(value, F.lit("-")), "-").otherwise(""),
                      F.array_join(F.slice(parts, F.lit(3), F.size(parts)), ""))
    return (F.when(kind == "phone", F.concat(phone, more)).when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", F.concat(card, more))
            .when(kind == "ssn", F.concat(new, more)).when(kind == "iban", F.concat(iban, more)).when(kind == "person", person)
            .otherwise(F.concat(secret, more)))


def keyed_order(names: list[str], key: str) -> list[str]:
    """The names in an order that the key alone tells."""
    return sorted(names, key=lambda name: hashlib.sha256("\1".join((key, "order", name)).encode()).digest())


def given_name(given: Column, key: str) -> Column:
    """Another name of the same gender and script: the next one in the keyed order of its
    list, so that no name is its own surrogate and no two share one."""
    found = F.lit(None).cast("string")
    for names in NAMES.values():
        order = keyed_order(names, key)
        listed = F.array(*map(F.lit, order))
        at = F.array_position(listed, given).cast("int")
        found = F.when(at > 0, F.get(listed, at % len(order))).otherwise(found)
    return found


def other_name(name: Column, title: Column, key: str) -> Column:
    """A surrogate for a name before the last: listed names by ``given_name``; others a
    listed one of the title's gender, or syllables where no title tells; initials other
    letters.  Particles stay."""
    hex_ = digest(F.lit("given"), F.lower(name), F.lit(0), key)
    of = lambda titles: title.rlike(rf"(?<!\p{{L}})(?:{'|'.join(titles)})(?!\p{{L}})")
    gender = F.when(of(FEMALE), "f").when(of(MALE), "m")
    drawn_ = F.initcap(F.array_join(syllables(name, hex_, 3), ""))
    for (script, of_gender), names in NAMES.items():
        listed = F.get(F.array(*map(F.lit, names)), number(hex_, 3, len(names)))
        drawn_ = F.when((script_of(name) == script) & (gender == of_gender), listed).otherwise(drawn_)
    return F.when(name.rlike(r"^\p{Ll}"), name).when(name.rlike(r"^[A-Z]\.$"), masked(name, hex_)).otherwise(
        F.coalesce(given_name(name, key), drawn_))


def dressed(kind: Column, entity: Column, new: Column, key: str) -> Column:
    """A surrogate's canonical text in the format the entity is written in."""
    plain = F.when(kind == "phone", F.concat(F.when(entity.startswith("+"), F.substring_index(new, "|", 1)).otherwise(F.lit("")),
                                             F.substring_index(new, "|", -1))).otherwise(new)
    number_of = lambda k, p: F.length(F.regexp_replace(F.substring(entity, F.lit(1), k + 1), p, ""))
    in_digits = each_character(entity, lambda c, k: F.when(c.rlike("[0-9]"), F.substring(plain, number_of(k, "[^0-9]"), F.lit(1))).otherwise(c))
    count = F.length(only_digits(entity))
    in_digits = F.concat(in_digits, F.substring(plain, count + 1, F.length(plain)))
    in_account = each_character(entity, lambda c, k: F.when(c == " ", c).otherwise(F.substring(new, number_of(k, " "), F.lit(1))))
    in_account = F.concat(in_account, F.substring(new, F.length(F.regexp_replace(entity, " ", "")) + 1, F.length(new)))
    in_case = each_character(entity, lambda c, k: F.when(c.rlike("[A-Z]"), F.upper(F.substring(new, k + 1, F.lit(1)))).otherwise(
        F.substring(new, k + 1, F.lit(1))))
    secret = F.when(entity.rlike("[A-F]"), F.upper(new)).otherwise(new)
    title = F.regexp_extract(entity, rf"^({TITLED}*)", 1)
    names = F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " ")
    before = F.transform(F.slice(names, 1, F.size(names) - 1), lambda name: F.concat(other_name(name, title, key), F.lit(" ")))
    family = F.array_join(F.transform(F.split(new, "-"), F.initcap), "-")
    person = F.concat(title, F.array_join(before, ""), family)
    return (F.when(kind.isin("phone", "card", "ssn"), in_digits).when(kind == "iban", in_account).when(kind == "email", F.when(F.length(new) == F.length(entity), in_case).otherwise(new))
            .when(kind == "person", person).when(kind == "secret", secret).otherwise(new))


def found_in(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def drawn_apart(entities: DataFrame, key: str) -> DataFrame:
    """``kind, value, new`` for distinct entities (``kind, value``), all ``new`` distinct and
    none a real entity.

    Of those that draw the same, one keeps it (the fewest attempts, then the smallest
    text); one that draws a real entity draws again.  A round is a count by text and joins
    by text.  Room grows with the attempts, but for IP addresses, of which there are only
    so many: where most of them are in use, this ends with an error.
    """
    state = entities.withColumn("attempt", F.lit(0))
    for _ in range(MOST_ATTEMPTS):
        hexed = state.withColumn("hex", digest(F.col("kind"), F.col("value"), F.col("attempt"), key))
        now = written(hexed.withColumn("new", drawn(F.col("kind"), F.col("value"), F.col("hex"), F.col("attempt"))).drop("hex"), "drawn")
        keeps = written(now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("keeper"), F.count("*").alias("n")).where("n > 1"), "keeps")
        real = now.select("kind", F.col("value").alias("new"), F.lit(True).alias("real"))
        clash = now.join(keeps.select("kind", "new", "keeper"), ["kind", "new"], "left").join(real, ["kind", "new"], "left")
        again = F.coalesce(F.col("real") | (F.struct("attempt", "value") != F.col("keeper")), F.lit(False))
        moved = written(clash.select("kind", "value", "new", "attempt", again.alias("again")), "attempts")
        if moved.where("again").isEmpty():
            return now.select("kind", "value", "new")
        state = moved.select("kind", "value", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    raise ValueError("there are more addresses than surrogates of their kind")


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` (``text`` and any others) with surrogates in ``text``, and ``n_entities``.

    Null stays null with 0 entities; a text without any stays as it is.  Repeated rows
    have the same surrogates.  A column called ``n_entities`` is replaced.
    """
    docs = docs.drop("n_entities")
    listed = docs.select(F.xxhash64("text").alias("h"), F.array_distinct(found_in("text")).alias("all")).where(F.size("all") > 0)
    each = listed.select("h", F.explode("all").alias("entity")).withColumn("kind", of_type(F.col("entity")))
    each = written(each.withColumn("value", canonical(F.col("kind"), F.col("entity"))).distinct(), "found")
    apart = drawn_apart(each.select("kind", "value").distinct(), key)
    # By text, not by row: texts that are equal have equal entities.
    named = each.join(apart, ["kind", "value"]).withColumn("new", dressed(F.col("kind"), F.col("entity"), F.col("new"), key))
    of_text = written(named.groupBy(F.col("h").alias("_h")).agg(F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("_new")), "of_text")
    # One plan at every size: texts meet their entities in a shuffled join.
    joined = docs.join(of_text.hint("merge"), F.xxhash64("text") == F.col("_h"), "left")
    entities = F.when(F.col("_new").isNotNull(), found_in("text"))
    changed = F.transform("_all", lambda entity: F.element_at("_new", entity))
    gaps = F.split("text", PATTERN, -1)
    text = F.when(F.col("_all").isNotNull(), F.array_join(F.zip_with(
        gaps, changed, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(F.col("text"))
    return joined.withColumn("_all", entities).select(
        *[text.alias("text") if c == "text" else c for c in docs.columns],
        F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("n_entities"))
