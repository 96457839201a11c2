"""Column expressions over texts: folding, tokens, sentences, chunks, labels, answers, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .temporal import col

#: Letters with accents, Greek and Cyrillic ones, and the Latin letter that each folds to. Letters at the end without a counterpart go.
ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿłšžčřěůđøāēīōūąęśźżńćğışţăőű" "αβγδεζηικλμνξοπρσςτυωάέήίόύώϊϋΐΰ" "абвгдезийклмнопрстуфыэіґў" "ъь"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyylszcreudoaeiouaeszzncgistaou" "abgdezeiklmnxoprsstuoaeeiouoiuiu" "abvgdeziiklmnoprstufyeigu"
#: Letters that fold to several.
DOUBLE = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"))
SCRIPTS = (("θ", "th"), ("φ", "ph"), ("χ", "kh"), ("ψ", "ps"), ("щ", "shch"), ("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("ю", "iu"), ("я", "ia"), ("ё", "io"), ("ї", "yi"), ("є", "ie"))
STOP_LABELS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "his", "but", "at", "are", "this", "have", "an", "or", "from", "le")
ANSWER_PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def fold(text) -> Column:
    """Lower case in Latin letters without accents: Greek and Cyrillic letters become the Latin ones that stand for them."""
    low = F.lower(col(text))

    def several(out: Column, letters) -> Column:
        for letter, plain in letters:
            out = F.replace(out, F.lit(letter), F.lit(plain))
        return out

    latin = several(F.translate(low, ACCENTS, PLAIN), DOUBLE)
    # Texts of one byte a letter have no accents, and few texts have other scripts.
    other = low.rlike("[\\x{370}-\\x{3ff}\\x{400}-\\x{4ff}]")
    return F.when(F.octet_length(low) == F.length(low), low).when(other, several(latin, SCRIPTS)).otherwise(latin)


def tokens(text) -> Column:
    """Words of the folded text, in any script; punctuation separates."""
    return F.array_remove(F.split(fold(text), r"[^\p{L}\p{N}_]+"), "")


def sentences(text) -> Column:
    """Sentences that end in . ! or ? before white space, trimmed, none empty."""
    cut = F.split(F.regexp_replace(col(text), r"([.!?])[ \t\n\r\f]+", "$1\x01"), "\x01")
    return F.filter(F.transform(cut, lambda s: F.btrim(s, F.lit(" \t\n\r\f"))), lambda s: s != "")


def words(text) -> Column:
    return F.filter(F.split(col(text), r"[ \t\n\r\f]+"), lambda w: w != "")


def fixed_chunks(text, size: int = 256, overlap: int = 20) -> Column:
    """Chunks of `size` words, each beginning size - overlap words after the one before."""
    w = words(text)
    at = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(w, i + 1, size), " "))


def budget_chunks(sents, title=None, budget: int = 512, overlap: int = 2, special: int = 2, count=None) -> Column:
    """Greedy chunks of whole sentences within a token budget, repeating the last `overlap` sentences if they fit.

    A sentence over the budget is a chunk of its own. `count` gives a sentence's tokens (words + special by default).
    One ordered fold over the array, on the JVM's side.
    """
    count = count or (lambda s: F.size(words(s)) + special)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, s: a + count(s))
    none = F.array().cast("array<string>")

    def step(acc, s):
        now, n = acc["now"], count(s)
        tail = F.slice(now, F.greatest(F.size(now) - overlap + 1, F.lit(1)), overlap)
        kept = F.when((F.size(now) > 0) & (total(tail) + n <= budget), tail).otherwise(none)
        done = F.when(F.size(now) > 0, F.concat(acc["done"], F.array(F.array_join(now, " ")))).otherwise(acc["done"])
        return (
            F.when(n > budget, F.struct(F.concat(done, F.array(s)).alias("done"), none.alias("now")))
            .when(total(now) + n <= budget, F.struct(acc["done"].alias("done"), F.concat(now, F.array(s)).alias("now")))
            .otherwise(F.struct(done.alias("done"), F.concat(kept, F.array(s)).alias("now")))
        )

    def end(acc):
        return F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["done"])

    out = F.aggregate(col(sents), F.struct(none.alias("done"), none.alias("now")), step, end)
    return out if title is None else F.transform(out, lambda c: F.concat(col(title), F.lit("\n"), c))


def label_allowed(label, stop=STOP_LABELS) -> Column:
    """Is a folded label worth linking: not empty, common, numeric, or of one letter?"""
    label = col(label)
    return (F.length(label) > 1) & ~label.isin(*stop) & ~label.rlike("^[0-9]+$")


def normal_answer(text) -> Column:
    """Lower case without punctuation and articles, single spaces."""
    plain = F.regexp_replace(F.lower(col(text)), ANSWER_PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"[ \t\n\r\f]+", " "))


def ontology_string(name, types, aliases) -> Column:
    return F.concat(F.lit("Name: $$"), col(name), F.lit("$$; Type: ["), F.array_join(col(types), ","), F.lit("]; Alias: ["), F.array_join(F.coalesce(col(aliases), F.array()), ","), F.lit("]"))


def parse_ontology(text) -> Column:
    """(name, type, alias) of an ontology string."""
    part = lambda p: F.regexp_extract(col(text), p, 1)
    listed = lambda p: F.filter(F.split(part(p), ","), lambda x: x != "")
    return F.struct(part(r"Name: \$\$(.*?)\$\$").alias("name"), listed(r"Type: \[(.*?)\]").alias("type"), listed(r"Alias: \[(.*?)\]").alias("alias"))


def triplet_string(source_names, relation, target_names) -> Column:
    return F.concat_ws("|", F.array_join(col(source_names), " "), col(relation), F.array_join(col(target_names), " "))


def entity_description(types, name) -> Column:
    return F.concat(F.lit("["), F.array_join(col(types), ","), F.lit("]: "), col(name))


def paragraph(title, content) -> Column:
    return F.concat(F.lit("Title:"), col(title), F.lit("\nContent:"), col(content))


def labelled(name, types, ident) -> Column:
    """name (types), or the id of an unknown node."""
    return F.coalesce(F.concat(col(name), F.lit(" ("), F.array_join(col(types), ", "), F.lit(")")), col(ident))


def repaired_json(text) -> Column:
    """JSON without code fences of any name, and without backslashes that begin no escape."""
    bare = F.regexp_replace(F.trim(col(text)), r"^```[A-Za-z]*\s*|\s*```$", "")
    return F.regexp_replace(bare, r"""(\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))|\\""", "$1")


def node_view(name, types, description, aliases, most: int = 200) -> Column:
    """What a model is shown of a node: its name, types, aliases and the beginning of its description; null for nodes without aliases, which are not shown."""
    text = F.nullif(col(description), F.lit(""))
    shown = F.struct(col(name).alias("entity"), col(types).alias("types"), F.concat(F.left(text, F.lit(most)), F.lit("...")).alias("description"), col(aliases).alias("aliases"))
    return F.when(F.size(F.coalesce(col(aliases), F.array().cast("array<string>"))) > 0, shown)


def merged_map(first, second, override: bool = True) -> Column:
    """The union of two maps; of a key in both the second's value stays, or the first's without `override`."""
    kept = F.map_filter(col(first), lambda k, v: ~F.map_contains_key(col(second), k)) if override else col(first)
    added = col(second) if override else F.map_filter(col(second), lambda k, v: ~F.map_contains_key(col(first), k))
    return F.map_concat(kept, added)


def intent(question) -> Column:
    """A rule for a question's temporal intent: ordering, explicit time, time by event, or none."""
    q = F.lower(col(question))
    return (
        F.when(q.rlike(r"\b(first|last|before|after|earlier|later|earliest|latest|prior to)\b"), "ordering")
        .when(q.rlike(r"\b[12]\d{3}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"), "explicit_temporal")
        .when(q.rlike(r"\b(during|when|while|since|until)\b"), "implicit_temporal")
        .otherwise("atemporal")
    )
