"""Personal data replaced by surrogates.

Detected entities are cut into pieces that can refer to the same thing elsewhere (the user
and the domain of an address, the parts of a name, the digits of a number). Every distinct
piece of the corpus gets one surrogate by a keyed hash: of its kind, script, length and
format, with valid check digits (cards, IBAN) and the known prefix of a key. Surrogates are
then checked: one that another piece also got, or that is itself found in the corpus, is drawn
again, until all are distinct, so different people stay different and mentions of one stay one.
A surrogate that keeps its length grows after eight draws, so the drawing ends.

Digits are a card or an IBAN only with valid check digits. A value after ``password=`` and the
like is a secret if it has six characters and a digit.

A name is found by its titles (one or more) and has any number of capitalised words, each with
a script of its own. A given name has the gender of its title; where that tells none, the one
its other mentions in the document tell, else in the corpus, if they agree. A lone word with a
title is a given name if the document has it only as such, else a family name. The words of a
name get the same surrogates elsewhere in that document without a title, neighbours counted as
one entity; a lone word stays if a document with titled names also has it in small letters
("Green" and "green tea"). Names never mentioned with a title are left, as is other text.

All of it is DataFrame operations. A piece with very many mentions meets its surrogate in a
join whose other side has it once.

Defined results: NULL text stays NULL with no entities, empty text empty; rows equal in id and
text are replaced alike and each returned; the same corpus and key give the same
surrogates; an empty table gives no rows; other columns are kept out of the result unless
``carry`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import growing, packed
from leadloom.session import freeze

# Patterns, tried in this order at each place of the text.
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GAP = r"[^\p{L}\p{N}]{1,8}"
_MALE = r"Mr|Sir|Herr|Herrn|Monsieur|Señor|Sr|г-н|господин|Κύριος"
_FEMALE = r"Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Mademoiselle|Señora|Señorita|Sra|Srta|г-жа|госпожа|Κυρία"
_NEUTRAL = r"Dr|Prof|Mx"
_NAME = r"\p{Lu}(?:(?!['’]s(?![\p{L}'’\-]))[\p{L}'’\-])+"
_TITLES = rf"(?:(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? )++"
_SECRET_NAME = (r"(?:(?i:password|passwd|pwd|secret|api[_\-]?key|token)[\"']?[ ]?[=:][ ]?[\"']?)")
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
             r"(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?)*\.\p{L}{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}"
              r"|sk-[0-9A-Za-z\-]{20,}|eyJ[0-9A-Za-z_\-]{5,}\.[0-9A-Za-z_\-]{5,}\.[0-9A-Za-z_\-]{5,})(?![0-9A-Za-z])"
              rf"|(?<![\p{{L}}\p{{N}}]){_SECRET_NAME}(?=[^\s\"'<>,;]{{0,127}}[0-9])[^\s\"'<>,;]{{5,}}[\p{{L}}\p{{N}}]",
    "ip": rf"(?<![0-9.])(?:{_BYTE}\.){{3}}{_BYTE}(?![0-9]|\.[0-9])"
          r"|(?<![0-9A-Za-z:.])(?=[a-fA-F:]{0,35}[0-9])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
          r"|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![0-9A-Za-z:])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "phone": rf"\+[0-9]{{1,3}}{_GAP}\(?[0-9]{{2,4}}\)?{_GAP}[0-9]{{3,4}}(?:[ .\-][0-9]{{2,4}}){{1,2}}(?![0-9])"
             r"|(?<![0-9+])\([0-9]{3}\)[^\p{L}\p{N}]{1,8}[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
             r"|(?<![0-9+.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9])"
             r"|\+[0-9]{1,3}[ .\-/]\(?[0-9]{1,5}\)?[ .\-/]?[0-9]{4,9}(?![0-9])"
             r"|(?<![0-9/])0[0-9]{1,5}/[0-9]{5,9}(?![0-9/])"
             r"|\+[0-9]{8,15}(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "name": rf"(?<!\p{{L}}){_TITLES}{_NAME}(?: (?!{_TITLES}){_NAME})*",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_WORD = rf"(?<!\p{{L}}){_NAME}"
_SMALL = r"(?<![\p{L}'’\-])\p{Ll}(?:(?!['’]s(?![\p{L}'’\-]))[\p{L}'’\-])+"

# Given names by script and gender, and syllables for family names.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Noel Oscar Paul",
    ("latin", "f"): "Alma Berta Clara Diana Emma Flora Greta Helena Irma Julia Karla Lena Maria Nora Olga Paula",
    ("latin", "n"): "Alex Bo Chris Dana Eden Frances Gale Kim Lee Morgan Noa Robin Sam Terry Val Wren",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Марк Олег Павел Роман Тимур Юрий",
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Инна Лидия Мария Нина Ольга Полина Раиса Юлия",
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура Паша Тоня Ася Рита Сима Тая Тася Фима Яся Вася Миша",
    ("greek", "m"): "Άρης Βίκτωρ Δήμος Ερμής Ζήνων Ηλίας Κίμων Λέων Μάρκος Νίκος Ορέστης Πάρις Σόλων Τίτος Φώτης Χάρης",
    ("greek", "f"): "Άννα Βάσω Δάφνη Ελένη Ζωή Ηρώ Ιρις Κλειώ Λήδα Μαρία Νίκη Όλγα Ρέα Σοφία Φωτεινή Χλόη",
    ("greek", "n"): "Αλέξη Βασίλη Δανάη Θάνο Ίων Κίμω Λίνο Μάνο Νέλλη Ξένο Πέλα Ρένο Σίλη Τάσο Φάνη Χάρι",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa po ra re ro sa se so ta te",
    "cyrillic": "ба бе бо да де до за зе ва ве га го ка ке ко ла ле ло ма ме мо на не но па по ра ре ро са се со",
    "greek": "βα βε βο δα δε δο ζα ζε γα γο κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε τα το",
}


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "\\x27")


def _mod97(text: str) -> str:
    """SQL: the remainder by 97 of digits and capitals, these read as 10 to 35."""
    return (f"aggregate(sequence(1, length({text})), 0, (n, i) -> CASE WHEN substring({text}, i, 1) RLIKE '[0-9]' "
            f"THEN (n * 10 + int(substring({text}, i, 1))) % 97 ELSE (n * 100 + ascii(substring({text}, i, 1)) - 55) % 97 END)")


def _kind_of(match: str) -> str:
    """SQL: the kind of an entity, by the first pattern that fits all of it; NULL if its check digits are wrong."""
    plain = f"replace({match}, ' ', '')"
    checks = {"card": f"AND luhn_check(regexp_replace({match}, '[^0-9]', ''))",
              "iban": f"AND {_mod97(f'concat(substring({plain}, 5), substring({plain}, 1, 4))')} = 1"}
    cases = " ".join(f"WHEN {match} RLIKE r'^(?:{_quoted(p)})$' {checks.get(k, '')} THEN '{k}'"
                     for k, p in PATTERNS.items())
    return f"CASE {cases} END"


def _script(text: str) -> str:
    return (f"CASE WHEN {text} RLIKE r'\\p{{IsCyrillic}}' THEN 'cyrillic' "
            f"WHEN {text} RLIKE r'\\p{{IsGreek}}' THEN 'greek' ELSE 'latin' END")


_TITLE = rf"^({_TITLES})"


def _pieces() -> str:
    """SQL: an entity ``m`` of kind ``kind`` as pieces (kind, text); a NULL kind is kept as it is."""
    def piece(kind: str, text: str) -> str:
        return f"struct({kind} AS kind, {text} AS text)"
    title = f"regexp_extract(m, r'{_TITLE}', 1)"
    names = f"split(substring(m, length({title}) + 1), ' ')"
    gender = (f"CASE WHEN {title} RLIKE r'(?:^| )(?:{_MALE})\\.? ' THEN 'm' "
              f"WHEN {title} RLIKE r'(?:^| )(?:{_FEMALE})\\.? ' THEN 'f' ELSE 'n' END")
    family = f"concat('family ', {_script('w')})"
    first = f"concat(IF(size({names}) > 1, 'given ', 'single '), {gender}, ' ', {_script('w')})"
    named = f"regexp_extract(m, r'^({_quoted(_SECRET_NAME)})', 1)"
    return f"""CASE
      WHEN kind = 'email' THEN array({piece("'user'", "substring_index(m, '@', 1)")},
        {piece("CAST(NULL AS STRING)", "'@'")}, {piece("'domain'", "substring_index(m, '@', -1)")})
      WHEN kind = 'name' THEN concat(array({piece("CAST(NULL AS STRING)", title)}), flatten(transform({names},
        (w, i) -> IF(i = 0, array({piece(first, "w")}),
        array({piece("CAST(NULL AS STRING)", "' '")}, {piece(family, "w")})))))
      WHEN kind = 'secret' THEN array({piece("CAST(NULL AS STRING)", named)},
        {piece("kind", f"substring(m, length({named}) + 1)")})
      ELSE array({piece("kind", "m")}) END"""


_CANON = ("CASE WHEN kind IN ('phone', 'card', 'ssn') THEN regexp_replace(text, '[^0-9]', '') "
          "WHEN kind = 'iban' THEN replace(text, ' ', '') WHEN kind = 'secret' THEN text ELSE lower(text) END")


def _draw(key: str, place: str) -> str:
    """SQL: a number from the keyed hash for one place of a surrogate."""
    secret = key.replace("\\", "\\\\").replace("'", "\\'")
    return (f"CAST(conv(substring(sha2(concat_ws('|', '{secret}', kind, canon, attempt, {place} div 8), 256), "
            f"int({place} % 8) * 8 + 1, 8), 16, 10) AS BIGINT)")


def _surrogate(key: str) -> str:
    """SQL: the surrogate of (kind, canon) at an attempt; open-ended kinds grow after a few."""
    def pick(chars: str, place: str = "i") -> str:
        return f"substring('{chars}', int({_draw(key, place)} % {len(chars)}) + 1, 1)"
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"
    greek = "αβγδεζηθικλμνξοπρστυφχψω"
    def chars(text: str, start: str = "0") -> str:
        c = f"substring({text}, int(i) + 1, 1)"
        return (f"array_join(transform(sequence(0, greatest(length({text}) - 1, 0)), i -> CASE "
                f"WHEN i < {start} THEN {c} "
                f"WHEN kind = 'ip' AND {c} <> ':' THEN {pick('0123456789abcdef')} "
                f"WHEN {c} RLIKE '[0-9]' THEN {pick('0123456789')} "
                f"WHEN kind = 'secret' AND canon RLIKE '^[0-9a-f]+$' THEN {pick('0123456789abcdef')} "
                f"WHEN kind = 'secret' AND canon RLIKE '^[0-9A-F]+$' THEN {pick('0123456789ABCDEF')} "
                f"WHEN {c} RLIKE '[A-Z]' THEN {pick(latin.upper())} "
                f"WHEN {c} RLIKE r'\\p{{IsCyrillic}}' THEN {pick(cyrillic)} "
                f"WHEN {c} RLIKE r'\\p{{IsGreek}}' THEN {pick(greek)} "
                f"WHEN {c} RLIKE r'\\p{{L}}' THEN {pick(latin)} ELSE {c} END), '')")
    more = (f"array_join(transform(sequence(0, attempt div 4), j -> IF(j = 0, '', {pick(latin, '(1000 + j)')})), '')")
    given = " ".join(
        f"WHEN kind = 'given {g} {s}' THEN lower(split('{names}', ' ')[int({_draw(key, '0')} % {len(names.split())})])"
        for (s, g), names in GIVEN.items())
    family = " ".join(
        f"WHEN kind = 'family {s}' THEN array_join(transform(sequence(0, 2 + attempt div 2), "
        f"i -> split('{names}', ' ')[int({_draw(key, 'i')} % {len(names.split())})]), '')"
        for s, names in SYLLABLES.items())
    tail = " ".join(
        f"WHEN kind LIKE 'given % {s}' THEN array_join(transform(sequence(0, attempt), i -> IF(i = 0, '', "
        f"split('{names}', ' ')[int({_draw(key, '(i + 8)')} % {len(names.split())})])), '')"
        for s, names in SYLLABLES.items())
    prefix = ("CASE WHEN canon LIKE 'AKIA%' OR canon RLIKE '^gh[pousr]_' THEN 4 "
              "WHEN canon LIKE 'sk-%' OR canon LIKE 'eyJ%' THEN 3 ELSE 0 END")
    # after eight draws more digits, so that a full kind has room
    longer = (f"array_join(transform(sequence(0, attempt div 8), j -> IF(j = 0, '', "
              f"{pick('0123456789', '(2000 + j)')})), '')")
    body = f"left({chars('canon', '1')}, length(canon) - 1)"
    card = f"concat({body}, {longer})"
    luhn = f"filter(sequence(0, 9), d -> luhn_check(concat({card}, d)))[0]"
    account = f"concat(substring({chars('canon', '4')}, 5), {longer})"
    check = f"lpad(98 - {_mod97(f'concat({account}, substring(canon, 1, 2), {chr(39)}00{chr(39)})')}, 2, '0')"
    octets = f"array_join(transform(sequence(0, 3), i -> int({_draw(key, 'i')} % 254) + 1), '.')"
    return f"""CASE
      WHEN kind = 'ip' AND NOT contains(canon, ':') AND attempt < 64 THEN {octets}
      WHEN kind = 'ip' THEN {chars("IF(contains(canon, ':'), canon, '0:0:0:0:0:0:0:0')")}
      WHEN kind = 'card' THEN concat({card}, {luhn})
      WHEN kind = 'iban' THEN concat(substring(canon, 1, 2), {check}, {account})
      WHEN kind = 'secret' THEN concat({chars('canon', prefix)}, {longer})
      WHEN kind IN ('phone', 'ssn') THEN concat({chars('canon', "IF(kind = 'phone', 1, 0)")}, {longer})
      WHEN kind = 'user' THEN concat({chars('canon')}, {more})
      WHEN kind = 'domain' THEN concat({more}, {chars("substring_index(canon, '.', size(split(canon, '[.]')) - 1)")},
        '.', substring_index(canon, '.', -1))
      WHEN kind LIKE 'given %' THEN concat(CASE {given} END, CASE {tail} END)
      WHEN kind LIKE 'family %' THEN CASE {family} END
      ELSE {chars('canon')} END"""


# The surrogate in the format of one mention: its separators, or its capitals; what it is longer comes last.
_FORMATTED = r"""CASE
  WHEN kind IS NULL THEN text
  WHEN kind IN ('phone', 'card', 'ssn') THEN concat(array_join(transform(sequence(0, length(text) - 1), i ->
    IF(substring(text, i + 1, 1) RLIKE '[0-9]',
       substring(surrogate, length(regexp_replace(substring(text, 1, i + 1), '[^0-9]', '')), 1),
       substring(text, i + 1, 1))), ''), substring(surrogate, length(canon) + 1))
  WHEN kind = 'iban' THEN concat(array_join(transform(sequence(0, length(text) - 1), i ->
    IF(substring(text, i + 1, 1) = ' ', ' ',
       substring(surrogate, length(replace(substring(text, 1, i + 1), ' ', '')), 1))), ''),
    substring(surrogate, length(canon) + 1))
  WHEN kind IN ('secret', 'ip') THEN surrogate
  WHEN text = upper(text) AND text <> lower(text) THEN upper(surrogate)
  WHEN kind LIKE 'given %' OR kind LIKE 'family %' THEN initcap(surrogate)
  WHEN substring(text, 1, 1) <> lower(substring(text, 1, 1)) THEN
    concat(upper(substring(surrogate, 1, 1)), substring(surrogate, 2))
  ELSE surrogate END"""


def _one_gender(parts: DataFrame) -> DataFrame:
    """Pieces with the kinds of names decided in each document: lone words, and genders its titles do not tell."""
    role, gender, script = (F.substring_index("kind", " ", 1), F.get(F.split("kind", " "), F.lit(1)),
                            F.substring_index("kind", " ", -1))
    named = F.coalesce(F.col("kind").rlike("^(given|family|single) "), F.lit(False))
    word = Window.partitionBy("doc_id", "_hash", "canon")
    seen = parts.where(named).withColumn("_role", role).withColumn(
        "_g", F.when(F.col("_role") != "family", gender)).withColumn("_script", script).select(
        "*", F.max(F.col("_role") == "given").over(word).alias("_given"),
        F.max(F.col("_role") == "family").over(word).alias("_family"),
        F.coalesce(F.max(F.col("_g") == "m").over(word), F.lit(False)).alias("_m"),
        F.coalesce(F.max(F.col("_g") == "f").over(word), F.lit(False)).alias("_f"))
    told = F.when((F.col("_g") != "n") | (F.col("_m") == F.col("_f")), F.col("_g")).otherwise(
        F.when(F.col("_m"), "m").otherwise("f"))
    as_given = (F.col("_role") == "given") | ((F.col("_role") == "single") & F.col("_given") & ~F.col("_family"))
    kind = F.when(as_given, F.concat(F.lit("given "), told, F.lit(" "), "_script")).otherwise(
        F.concat(F.lit("family "), "_script"))
    return parts.where(~named).unionByName(seen.withColumn("kind", kind).select(*parts.columns))


def _same_person(known: DataFrame) -> DataFrame:
    """(kind, canon, as): given names without a gender that all other mentions of the corpus give one."""
    def has(g: str) -> Column:
        return F.bool_or(F.col("kind").startswith(f"given {g} "))
    words = known.where("kind LIKE 'given %'").groupBy(
        F.substring_index("kind", " ", -1).alias("_script"), "canon").agg(
        has("n").alias("_n"), has("m").alias("_m"), has("f").alias("_f"))
    return words.where("_n AND _m <> _f").select(
        F.concat(F.lit("given n "), "_script").alias("kind"), "canon",
        F.concat(F.when(F.col("_m"), "given m ").otherwise("given f "), "_script").alias("as"))


def surrogates(pieces: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for the distinct (kind, canon): all surrogates of a kind differ
    from each other and from every piece of the corpus."""
    made = F.expr(_surrogate(key))
    known = freeze(pieces.distinct(), "pii-pieces")
    same = freeze(_same_person(known), "pii-same")
    state = freeze(known.join(growing(same), ["kind", "canon"], "left_anti")
                   .withColumn("attempt", F.lit(0)).withColumn("surrogate", made), "pii-surrogates")
    while True:
        first = state.groupBy("kind", "surrogate").agg(
            F.min(F.struct("attempt", "canon")).alias("_first"))
        taken = known.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("_found"))
        marked = state.join(first, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left").withColumn(
            "_again", F.col("_found").isNotNull() | (F.col("_first.canon") != F.col("canon")))
        marked = freeze(marked.select("kind", "canon", "attempt", "surrogate", "_again"), "pii-marked")
        if marked.where("_again").isEmpty():
            state = state.select("kind", "canon", "surrogate")
            return state.unionByName(same.join(
                growing(state.withColumnRenamed("kind", "as")), ["as", "canon"]).select("kind", "canon", "surrogate"))
        drawn = marked.where("_again").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        state = freeze(marked.where("NOT _again").select("kind", "canon", "attempt", "surrogate")
                       .union(drawn.withColumn("surrogate", made)), "pii-surrogates")


def _named(names: Column) -> Column:
    """Canonical name word -> (surrogate, small), from a document's (canon, kind, surrogate, small) structs."""
    ordered = F.array_sort(F.array_distinct(F.flatten(names)))
    return F.map_from_entries(F.transform(_with_previous(ordered), lambda x: F.struct(
        x["x"]["canon"], F.struct(x["x"]["surrogate"], x["x"]["small"]))))


def _with_previous(ordered: Column) -> Column:
    """The entries of a sorted array whose canon differs from the one before, as structs ``x``."""
    before = F.concat(F.array(F.lit("")), F.transform(ordered, lambda x: x["canon"]))
    return F.filter(F.zip_with(ordered, F.slice(before, 1, F.size(ordered)), lambda x, b: F.struct(
        x.alias("x"), b.alias("b"))), lambda y: y["x"]["canon"] != y["b"])


def _let(value: Column, fn) -> Column:
    """fn(value), which is computed once however often fn reads it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _untitled(gap: Column, named: Column) -> Column:
    """(text, n): the text between entities with the document's names replaced, and how many.

    Linear in the gap: each word meets flags of the words before and after it that are zipped to it.
    """
    items = F.zip_with(F.regexp_extract_all(gap, F.lit(_WORD), F.lit(0)), F.split(gap, _WORD, -1),
                       lambda w, b: F.struct(w.alias("w"), b.alias("b"), named[F.lower(w)].alias("s")))

    def flags(read: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(False)), F.transform(read, lambda r: r["s"].isNotNull())),
                         1, F.size(read))
        return F.zip_with(read, before, lambda r, p: F.struct(
            r["w"].alias("w"), r["b"].alias("b"), r["s"].alias("s"),
            (r["s"].isNotNull() & p & (r["b"] == " ")).alias("joined")))

    def written(read: Column) -> Column:
        after = F.concat(F.slice(F.transform(read, lambda r: r["joined"]), 2, F.size(read)), F.array(F.lit(False)))
        return F.zip_with(read, after, lambda r, n: F.struct(
            r["b"].alias("b"), r["joined"].alias("joined"), F.when(
                r["s"].isNotNull() & (r["joined"] | n | ~r["s"]["small"]),
                F.when(r["w"] == F.upper(r["w"]), F.upper(r["s"]["surrogate"])).otherwise(
                    F.initcap(r["s"]["surrogate"]))).alias("new"), r["w"].alias("w")))

    def result(out: Column) -> Column:
        text = F.array_join(F.transform(out, lambda r: F.concat(
            r["b"], F.coalesce(r["new"], r["w"], F.lit("")))), "")
        n = F.size(F.filter(out, lambda r: r["new"].isNotNull() & ~r["joined"]))
        return F.struct(text.alias("text"), n.alias("n"))
    return _let(items, lambda read: _let(flags(read), lambda marked: _let(written(marked), result)))


def replace_personal_data(docs: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text with surrogates, number of entities in all and per kind, and ``carry``."""
    titled = F.exists("_all", lambda m: m.rlike(_TITLE))
    found = docs.select("doc_id", F.xxhash64("text").alias("_hash"), "text", F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(ANY), F.lit(0)).alias("_all")).where("size(_all) > 0")
    found = freeze(found.select("doc_id", "_hash", "_all", F.when(titled, F.array_distinct(
        F.regexp_extract_all("text", F.lit(_SMALL), F.lit(0)))).alias("_small")), "pii-found")
    small = found.select(F.explode("_small").alias("canon")).distinct().withColumn("small", F.lit(True))
    mentions = freeze(found.select("doc_id", "_hash", "_all").distinct()
                      .select("doc_id", "_hash", F.posexplode("_all").alias("_at", "m"))
                      .withColumn("kind", F.expr(_kind_of("m"))), "pii-mentions")
    parts = mentions.select("doc_id", "_hash", "_at", F.col("kind").alias("_entity"), F.posexplode(
        F.expr(_pieces())).alias("_part", "_piece")).select(
        "doc_id", "_hash", "_at", "_entity", "_part", "_piece.kind", "_piece.text").withColumn("canon", F.expr(_CANON))
    parts = freeze(_one_gender(freeze(parts, "pii-cut")), "pii-parts")
    drawn = surrogates(parts.where("kind IS NOT NULL").select("kind", "canon"), key)
    of_names = F.col("kind").rlike("^(given|family) ")
    table = drawn.where(~of_names).withColumn("small", F.lit(False)).unionByName(
        drawn.where(of_names).join(growing(small), "canon", "left").select(
            "kind", "canon", "surrogate", F.coalesce("small", F.lit(False)).alias("small")))
    written = parts.join(freeze(table, "pii-table"), ["kind", "canon"], "left").withColumn("_new", F.expr(_FORMATTED))
    entities = written.groupBy("doc_id", "_hash", "_at", "_entity").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_part", "_new"))), lambda p: p["_new"]), "").alias("_new"),
        F.collect_list(F.when(of_names, F.struct("canon", "kind", "surrogate", "small"))).alias("_names"))
    rows = entities.groupBy(F.col("doc_id").alias("_id"), F.col("_hash")).agg(
        F.array_sort(F.collect_list(F.struct("_at", "_new"))).alias("_list"),
        _named(F.collect_list("_names")).alias("_named"), F.count("_entity").cast("int").alias("_n"),
        *[F.count_if(F.col("_entity") == k).alias(f"n_{k}") for k in PATTERNS])
    rows = freeze(rows, "pii-rows")
    around = F.transform(F.split("_row.text", ANY, -1), lambda g: F.when(
        F.size("_named") > 0, _untitled(g, F.col("_named"))).otherwise(F.struct(g.alias("text"), F.lit(0).alias("n"))))
    rebuilt = F.array_join(F.zip_with(
        F.transform("_around", lambda g: g["text"]),
        F.concat(F.transform("_list", lambda e: e["_new"]), F.array(F.lit(""))),
        lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    none = F.col("_list").isNull()
    more = F.aggregate("_around", F.lit(0), lambda n, g: n + g["n"])
    placed = packed(docs).join(growing(rows), F.col("_row.doc_id").eqNullSafe(F.col("_id"))
                               & (F.xxhash64("_row.text") == F.col("_hash")), "left").withColumn(
        "_around", F.when(~none, around))
    return placed.select(
        "_row.doc_id", F.when(none, F.col("_row.text")).otherwise(rebuilt).alias("text"),
        F.when(none, 0).otherwise(F.col("_n") + more).alias("n_entities"),
        *[F.coalesce(F.col(f"n_{k}") + more if k == "name" else F.col(f"n_{k}"), F.lit(0)).alias(f"n_{k}")
          for k in PATTERNS],
        *[F.col(f"_row.`{c}`") for c in carry if c not in ("doc_id", "text")])
