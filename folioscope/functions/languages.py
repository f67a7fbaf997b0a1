"""OCR languages: display names and engine codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Display name and engine code, in natural order.
CATALOGUE = {
    "Afrikaans": "afr",
    "Albanian": "sqi",
    "Amharic": "amh",
    "Arabic (Script)": "Arabic",
    "Arabic": "ara",
    "Armenian (Script)": "Armenian",
    "Armenian": "hye",
    "Assamese": "Assamese",
    "Azerbaijani - Cyrillic": "aze_cyrl",
    "Azerbaijani": "aze",
    "Basque": "eus",
    "Belarusian": "bel",
    "Bengali (Script)": "Bengali",
    "Bengali": "ben",
    "Bosnian": "bos",
    "Breton": "bre",
    "Bulgarian": "bul",
    "Burmese": "mya",
    "Canadian Aboriginal (Script)": "Canadian_Aboriginal",
    "Catalan/Valencian": "cat",
    "Cebuano": "ceb",
    "Central Khmer": "khm",
    "Cherokee (Script)": "Cherokee",
    "Cherokee": "chr",
    "Chinese Simplified": "chi_sim",
    "Chinese Traditional": "chi_tra",
    "Corsican": "cos",
    "Croatian": "hrv",
    "Cyrillic (Script)": "Cyrillic",
    "Czech": "ces",
    "Danish": "dan",
    "Devanagari (Script)": "Devanagari",
    "Dhivehi": "div",
    "Dutch/Flemish": "nld",
    "Dzongkha": "dzo",
    "English": "eng",
    "English, Middle, 1100-1500": "enm",
    "Esperanto": "epo",
    "Estonian": "est",
    "Ethiopic (Script)": "Ethiopic",
    "Faroese": "fao",
    "Filipino": "fil",
    "Finnish": "fin",
    "Fraktur (Script)": "Fraktur",
    "French": "fra",
    "French, Middle, ca.1400-1600": "frm",
    "Galician": "glg",
    "Georgian (Script)": "Georgian",
    "Georgian - Old": "kat_old",
    "Georgian": "kat",
    "German Fraktur Latin": "deu_latf",
    "German": "deu",
    "Greek (Script)": "Greek",
    "Greek, Ancient, to 1453": "grc",
    "Greek, Modern, 1453-": "ell",
    "Gujarati (Script)": "Gujarati",
    "Gujarati": "guj",
    "Gurmukhi (Script)": "Gurmukhi",
    "Haitian/Haitian Creole": "hat",
    "Han Simplified (Script)": "HanS",
    "Han Simplified - Vertical (Script)": "HanS_vert",
    "Han Traditional (Script)": "HanT",
    "Han Traditional - Vertical (Script)": "HanT_vert",
    "Hangul (Script)": "Hangul",
    "Hangul - Vertical (Script)": "Hangul_vert",
    "Hebrew (Script)": "Hebrew",
    "Hebrew": "heb",
    "Hindi": "hin",
    "Hungarian": "hun",
    "Icelandic": "isl",
    "Indonesian": "ind",
    "Inuktitut": "iku",
    "Irish": "gle",
    "Italian - Old": "ita_old",
    "Italian": "ita",
    "Japanese (Script)": "Japanese",
    "Japanese - Vertical (Script)": "Japanese_vert",
    "Japanese": "jpn",
    "Javanese": "jav",
    "Kannada (Script)": "Kannada",
    "Kannada": "kan",
    "Kazakh": "kaz",
    "Khmer (Script)": "Khmer",
    "Kirghiz/Kyrgyz": "kir",
    "Korean Vertical": "kor_vert",
    "Korean": "kor",
    "Kurdish Kurmanji": "kmr",
    "Lao (Script)": "Lao",
    "Lao": "lao",
    "Latin (Script)": "Latin",
    "Latin": "lat",
    "Latvian": "lav",
    "Lithuanian": "lit",
    "Luxembourgish": "ltz",
    "Macedonian": "mkd",
    "Malay": "msa",
    "Malayalam (Script)": "Malayalam",
    "Malayalam": "mal",
    "Maltese": "mlt",
    "Maori": "mri",
    "Marathi": "mar",
    "Math Equations": "equ",
    "Mongolian": "mon",
    "Myanmar (Script)": "Myanmar",
    "Nepali": "nep",
    "Norwegian": "nor",
    "Occitan, 1500-": "oci",
    "Odia (Script)": "Odia",
    "Oriya": "ori",
    "Panjabi/Punjabi": "pan",
    "Persian": "fas",
    "Polish": "pol",
    "Portuguese": "por",
    "Pushto/Pashto": "pus",
    "Quechua": "que",
    "Romanian/Moldavian/Moldovan": "ron",
    "Russian": "rus",
    "Sanskrit": "san",
    "Scottish Gaelic": "gla",
    "Serbian - Latin": "srp_latn",
    "Serbian": "srp",
    "Sindhi": "snd",
    "Sinhala (Script)": "Sinhala",
    "Sinhala/Sinhalese": "sin",
    "Slovak": "slk",
    "Slovenian": "slv",
    "Spanish/Castilian": "spa",
    "Spanish/Old Castilian": "spa_old",
    "Sundanese": "sun",
    "Swahili": "swa",
    "Swedish": "swe",
    "Syriac (Script)": "Syriac",
    "Syriac": "syr",
    "Tajik": "tgk",
    "Tamil (Script)": "Tamil",
    "Tamil": "tam",
    "Tatar": "tat",
    "Telugu (Script)": "Telugu",
    "Telugu": "tel",
    "Thaana (Script)": "Thaana",
    "Thai (Script)": "Thai",
    "Thai": "tha",
    "Tibetan (Script)": "Tibetan",
    "Tibetan": "bod",
    "Tigrinya": "tir",
    "Tonga": "ton",
    "Turkish": "tur",
    "Uighur/Uyghur": "uig",
    "Ukrainian": "ukr",
    "Urdu": "urd",
    "Uzbek - Cyrilic": "uzb_cyrl",
    "Uzbek": "uzb",
    "Vietnamese (Script)": "Vietnamese",
    "Vietnamese": "vie",
    "Welsh": "cym",
    "West Frisian": "fry",
    "Yiddish": "yid",
    "Yoruba": "yor",
}


def catalogue() -> dict[str, str]:
    return dict(CATALOGUE)


def catalogue_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(catalogue().items()), "name string, code string")


def code_of(name: Column) -> Column:
    """The engine code of a display name; null if it isn't in the catalogue."""
    return F.create_map(*[F.lit(x) for pair in catalogue().items() for x in pair])[name]
