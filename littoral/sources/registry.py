"""The hazard dimension, stations and places as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import HAZARDS, LANDMARKS


def hazards(spark: SparkSession) -> DataFrame:
    rows = [(k, i, v, r, w, label) for i, (k, v, r, w, label) in enumerate(HAZARDS)]
    return spark.createDataFrame(rows, "hazard_type string, place int, variables array<string>, recipe string, event_words array<string>, label string")


def hazards_from_yaml(spark: SparkSession, folder: str) -> DataFrame:
    """One file for each hazard: key, order and whatever of variables, recipe, words and label it states. A key that is
    missing or given twice is an error."""
    import yaml

    files = spark.sparkContext.wholeTextFiles(f"{folder}/*.yaml").collect()  # a few small files
    seen: dict[str, tuple] = {}
    for path, body in files:
        raw = yaml.safe_load(body) or {}
        key = raw.get("key")
        if not key or key in seen:
            raise ValueError(f"{path}: " + ("two hazards have this key" if key else "no key"))
        label = raw.get("alert_label_en") or key.replace("_", " ").title()
        seen[key] = (key, int(raw.get("order", 999)), list(raw.get("instrument_variables") or []), raw.get("satellite_recipe"), list(raw.get("cap_event_keywords") or []), label)
    rows = sorted(seen.values(), key=lambda r: (r[1], r[0]))
    return spark.createDataFrame(rows, "hazard_type string, place int, variables array<string>, recipe string, event_words array<string>, label string")


LANGUAGES = ("en", "ta", "te")


def labels(spark: SparkSession, folder: str, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """hazard_type, lang, menu, speech, alert: what each hazard is called in each language by hazard files. A menu or speech
    label that a language lacks is the English one; alerts use their own English text, and other languages' speech."""
    import yaml

    rows = []
    for _, body in sorted(spark.sparkContext.wholeTextFiles(f"{folder}/*.yaml").collect()):  # a few small files
        raw = yaml.safe_load(body) or {}
        plain = title(raw["key"])
        menu, speech = ({"en": plain} | (raw.get(kind) or {}) for kind in ("menu_label", "speech_label"))
        alert = raw.get("alert_label_en") or plain
        for lang in languages:
            own = alert if lang == "en" else speech.get(lang) or alert
            rows.append((raw["key"], lang, menu.get(lang) or menu["en"], speech.get(lang) or speech["en"], own))
    return spark.createDataFrame(rows, "hazard_type string, lang string, menu string, speech string, alert string")


def title(key: str) -> str:
    return key.replace("_", " ").title()


def labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (hazard_type, lang) with menu, speech and alert labels; a hazard that isn't known is called by its key, and a
    language that isn't by its English labels."""
    english = known.filter("lang = 'en'").select("hazard_type", *(F.col(c).alias(f"{c}_en") for c in ("menu", "speech", "alert")))
    both = rows.join(F.broadcast(known), ["hazard_type", "lang"], "left").join(F.broadcast(english), "hazard_type", "left")  # nine hazards, few languages
    plain = F.initcap(F.replace("hazard_type", F.lit("_"), F.lit(" ")))
    names = {c: F.coalesce(c, f"{c}_en", plain) for c in ("menu", "speech", "alert")}
    return both.withColumns(names).drop(*(f"{c}_en" for c in names))


def faq_entries(spark: SparkSession, folder: str) -> DataFrame:
    """id, title, content, lang of all questions and answers that hazard files hold, with English where none is said."""
    import yaml

    files = spark.sparkContext.wholeTextFiles(f"{folder}/*.yaml").collect()  # a few small files
    entries = [e for _, body in sorted(files) for e in (yaml.safe_load(body) or {}).get("faq") or ()]
    rows = [(e["id"], e["title"], e["content"], e.get("lang", "en")) for e in entries]
    return spark.createDataFrame(rows, "id string, title string, content string, lang string")


def seed_once(spark: SparkSession, table: str, source: str, schema: str, defaults: dict[str, object] | None = None) -> bool:
    """Loads a JSON list into a Parquet table that is absent or empty; whether it did. An absent source loads nothing.
    Nulls in the columns of ``defaults`` become those values."""

    def there(path: str) -> bool:
        sc = spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)

    if not there(source) or there(table) and not spark.read.schema(schema).parquet(table).isEmpty():
        return False
    spark.read.option("multiLine", True).schema(schema).json(source).fillna(defaults or {}).write.mode("overwrite").parquet(table)
    return True


def enabled_stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("id string, name string, lat double, lon double, variables array<string>, enabled boolean").json(path).filter("enabled")


def landmarks(spark: SparkSession) -> DataFrame:
    """Places by the digit that chooses them."""
    return spark.createDataFrame([(str(i), *x) for i, x in enumerate(LANDMARKS, 1)], "digit string, name string, lat double, lon double")
