"""Lookup tables. All values here are fixed: results depend on them word for word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of property types.
TYPE_ALIASES = {
    "apartments": "apartment", "villas": "villa", "chalets": "chalet", "retail": "shop", "medical": "clinic",
    "townhouses": "townhouse", "twinhouses": "twinhouse", "twin_house": "twinhouse", "town_house": "townhouse",
    "بنتهاوس": "penthouse", "administrative": "office",
}
# The class of a property type.
CLASSES = {
    "apartment": "apartment", "studio": "apartment", "duplex": "apartment", "penthouse": "apartment",
    "loft": "apartment", "roof": "apartment", "chalet": "chalet", "cabin": "chalet", "villa": "house",
    "townhouse": "house", "twinhouse": "house", "house": "house", "family house": "house",
}
# The class of a finishing.
FINISHING = {
    "finished": "finished", "fully_finished": "finished", "lux": "finished", "super_lux": "finished",
    "extra_super_lux": "finished", "unfurnished": "finished", "furnished": "furnished",
    "semi_finished": "semi_finished", "core_shell": "core_shell",
}
# Delivery words that mean "ready"; words that mean "no value".
READY = ("ready", "ready_to_move", "new", "used", "فوري", "immediate", "delivered")
EMPTY = ("", "none", "null", "unknown", "n/a", "na", "-", "not specified")
# Spellings of districts.
DISTRICTS = {
    "fifth settlement": "New Cairo", "5th settlement": "New Cairo", "the 5th settlement": "New Cairo",
    "new cairo city": "New Cairo", "التجمع الخامس": "New Cairo", "القاهرة الجديدة": "New Cairo",
    "التجمع الأول": "New Cairo", "التجمع الثالث": "New Cairo", "التجمع السادس": "6th settlement",
    "sheikh zayed": "El Sheikh Zayed", "el sheikh zayed city": "El Sheikh Zayed", "الشيخ زايد": "El Sheikh Zayed",
    "زايد الجديدة": "New Zayed", "6 october": "6th of October City", "6th of october": "6th of October City",
    "october": "6th of October City", "السادس من أكتوبر": "6th of October City", "6 أكتوبر": "6th of October City",
    "6 اكتوبر": "6th of October City", "حدائق أكتوبر": "October Gardens", "أكتوبر الجديدة": "Northern Expansion",
    "new capital": "New Capital City", "new administrative capital": "New Capital City",
    "العاصمة الإدارية الجديدة": "New Capital City", "العاصمة الادارية الجديدة": "New Capital City",
    "mostakbal city": "Mostakbal City", "el mostakbal": "Mostakbal City", "مدينة المستقبل": "Mostakbal City",
    "المستقبل سيتي": "Mostakbal City", "مدينتي": "Madinaty", "الشروق": "El Shorouk",
    "هليوبوليس الجديدة": "New Heliopolis", "مدينة نصر": "Nasr City", "زهراء المعادي": "Maadi",
    "الساحل الشمالي": "North Coast", "north coast-sahel": "North Coast", "رأس الحكمة": "Ras El Hekma",
    "سيدي عبد الرحمن": "Sidi Abdel Rahman", "العلمين الجديدة": "Al Alamein", "العلمين": "Al Alamein",
    "الضبعة": "Al Dabaa", "العين السخنة": "Ain Sokhna", "مكادي": "Makadi", "رأس سدر": "Ras Sudr",
    "الإسكندرية": "Alexandria", "الاسكندرية": "Alexandria",
}
# Districts that only a search understands.
SEARCH_DISTRICTS = DISTRICTS | {
    "مدينة ٦ أكتوبر": "6th of October City", "مدينة 6 أكتوبر": "6th of October City", "مدينتي": "Madinaty",
    "التوسعات الشمالية": "Northern Expansion", "المعادي": "Maadi", "برج العرب": "Borg el arab",
}
# Spellings of developers.
DEVELOPERS = {
    "tmg": "talaatmoustafa", "talaat moustafa": "talaatmoustafa", "طلعت مصطفى": "talaatmoustafa",
    "هايد بارك": "hydepark", "هايدبارك": "hydepark", "بالم هيلز": "palmhills", "بالم هيلز للتعمير": "palmhills",
    "مدينة مصر": "madinetmasr", "مدينه مصر": "madinetmasr", "حسن علام": "hassanallam", "ماونتن فيو": "mountainview",
    "ماونتن فيو مصر": "mountainview", "مصر ايطاليا": "italia", "مصر إيطاليا": "italia", "الكازار": "ilcazar",
    "سوديك": "sodic", "إعمار": "emaar", "اعمار": "emaar", "إعمار مصر": "emaar", "اعمار مصر": "emaar", "أورا": "ora",
    "اورا": "ora", "تطوير مصر": "tatweer", "لافيستا": "lavista", "لا فيستا": "lavista", "بدر الدين": "badreldin",
    "معمار المرشدي": "maamarelmorshedy", "المراسم": "almarasem", "مراكز": "marakez", "سيتي إيدج": "cityedge",
    "سيتي ايدج": "cityedge", "الأهلي صبور": "alahlysabbour", "الاهلي صبور": "alahlysabbour",
    "أوراسكوم": "orascom", "اوراسكوم": "orascom",
}
# Spellings of compounds.
COMPOUNDS = {
    "باديا": "badya", "سراي": "sarai", "بارك سنترال": "park-central", "سيليا": "celia", "مدينتي": "madinaty",
    "الرحاب": "el-rehab", "ميفيدا": "mivida", "تاج سيتي": "taj-city", "كايرو فستيفال سيتي": "cairo-festival-city",
    "فيليت": "villette", "زد ايست": "zed-east", "ايست تاون": "eastown", "هاسيندا باي": "hacienda-bay",
    "هاسيندا وايت": "hacienda-white", "ماراسي": "marassi", "مراسي": "marassi", "فوكا باي": "fouka-bay",
    "سولت": "salt", "جيفيرا": "jefaira", "بالم هيلز القاهرة الجديدة": "palm-hills-new-cairo", "البوسكو": "il-bosco-city",
    "البوسكو سيتي": "il-bosco-city", "البوسكو سيتى": "il-bosco-city", "هاب تاون": "haptown", "ذا كريست": "the-crest",
    "كريك تاون": "creektown", "بلوم فيلدز": "bloomfields", "سوديك ايست": "sodic-east", "جاردن ليكس": "garden-lakes",
}
# Words of compound names that identify nothing.
GENERIC = (
    "the", "el", "al", "la", "il", "new", "compound", "city", "residence", "residences", "park", "hills", "mountain",
    "view", "palm", "hyde", "project", "phase", "كمبوند", "مشروع",
)
# Patterns of property types, finishing, delivery and resale evidence; the first match counts.
PROPERTY_PATTERNS = (
    (r"twin\s*house|توين", "twinhouse"), (r"town\s*house|تاون", "townhouse"),
    (r"pent\s*house|بينت|بنتا?\s*هاوس", "penthouse"), (r"duplex|دوبلكس", "duplex"), (r"studio|ستوديو", "studio"),
    (r"villa|فيلا", "villa"), (r"chalet|شاليه", "chalet"), (r"apartment|شقة|شقق", "apartment"), (r"رووف|roof", "roof"),
    (r"أرض|ارض|land", "land"), (r"عمارة|building", "building"), (r"مكتب|ادارى|إداري|office", "office"),
    (r"محل|متجر|shop|retail", "shop"), (r"عيادة|صيدلية|clinic|pharmacy", "clinic"), (r"warehouse|مخزن", "warehouse"),
)
FINISHING_PATTERNS = (
    (r"إكسترا سوبر لوكس|اكسترا سوبر لوكس|extra\s*super\s*lux", "extra_super_lux"), (r"سوبر لوكس|super\s*lux", "super_lux"),
    (r"لوكس\b|lux\b|fully\s*finished|مكمل التشطيب", "lux"),
    (r"نصف تشطيب|نص تشطيب|نصف تشطبات|semi\s*finished", "semi_finished"),
    (r"على الطوب الأحمر|الطوب الاحمر|بدون تشطيب|core\s*(&|and)\s*shell|shell", "core_shell"),
)
DELIVERY_PATTERNS = (
    (r"استلام فوري|استلام حالى|استلام حالي|ready\s*to\s*(move|occupy)", "ready_to_move"),
    (r"قيد الإنشاء|قيد الانشاء|تحت الإنشاء|under\s*construction|على الخريطة", "under_construction"),
    (r"جديدة أول ساكن|جديدة اول ساكن|أول ساكن", "new"), (r"مستعمل|used|بالاستلام", "used"),
)
RESALE_PATTERNS = (
    (r"\bresale\b", "keyword 'resale'"), (r"ريسيل", "keyword 'ريسيل' (resale)"),
    (r"تمليك", "«تمليك» (freehold — secondary-market phrasing)"), (r"من المالك", "owner-direct sale (secondary market)"),
)
SELLER_PATTERNS = (
    (r"من المطور|المطور مباشرة|by developer", "developer"), (r"من المالك مباشرة|من المالك|by owner|no broker", "owner"),
    (r"بواسطة سمسار|سمسار|وسيط عقاري|broker|agent", "broker"),
)
# Arabic number words; the order decides.
COUNT_WORDS = {
    "واحد": 1, "واحدة": 1, "اثنان": 2, "اثنين": 2, "غرفتين": 2, "حمامين": 2, "ثلاث": 3, "ثلاثة": 3, "ثلاث غرف": 3,
    "أربع": 4, "اربع": 4, "خمس": 5, "ست": 6, "ستة": 6, "سبع": 7, "ثمان": 8, "تسع": 9, "عشر": 10,
}
# Governorates by the names in use.
GOVERNORATES = {
    "القاهرة": "cairo", "cairo": "cairo", "الجيزة": "giza", "giza": "giza", "6 أكتوبر": "giza", "6 اكتوبر": "giza",
    "الشيخ زايد": "giza", "الإسكندرية": "alexandria", "الاسكندرية": "alexandria", "alexandria": "alexandria",
    "القليوبية": "qalyubia", "qalyubia": "qalyubia", "الدقهلية": "dakahlia", "dakahlia": "dakahlia",
    "الشرقية": "sharqia", "sharqia": "sharqia", "الغربية": "gharbia", "gharbia": "gharbia", "المنوفية": "menoufia",
    "menoufia": "menoufia", "البحيرة": "beheira", "beheira": "beheira", "كفر الشيخ": "kafr_el_sheikh",
    "kafr elsheikh": "kafr_el_sheikh", "دمياط": "damietta", "damietta": "damietta", "بورسعيد": "port_said",
    "بور سعيد": "port_said", "port said": "port_said", "الإسماعيلية": "ismailia", "الاسماعيلية": "ismailia",
    "ismailia": "ismailia", "السويس": "suez", "suez": "suez", "شمال سيناء": "north_sinai", "جنوب سيناء": "south_sinai",
    "مطروح": "matrouh", "matrouh": "matrouh", "البحر الأحمر": "red_sea", "البحر الاحمر": "red_sea", "red sea": "red_sea",
    "الوادي الجديد": "new_valley", "بني سويف": "beni_suef", "beni suef": "beni_suef", "المنيا": "minya",
    "minya": "minya", "الفيوم": "fayoum", "fayoum": "fayoum", "أسيوط": "assiut", "اسيوط": "assiut", "assiut": "assiut",
    "سوهاج": "sohag", "sohag": "sohag", "قنا": "qena", "qena": "qena", "الأقصر": "luxor", "الاقصر": "luxor",
    "luxor": "luxor", "أسوان": "aswan", "اسوان": "aswan", "aswan": "aswan", "العاصمة الإدارية الجديدة": "cairo",
    "العاصمة الادارية الجديدة": "cairo", "new administrative capital": "cairo",
}


def lookup(table: dict, key: Column) -> Column:
    """The value of key in a small literal map; null where it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def first_match(patterns, text: Column, lower: bool = True) -> Column:
    """The name of the first pattern that text contains."""
    text = F.lower(text) if lower else text
    return F.coalesce(*(F.when(text.rlike(p), F.lit(name)) for p, name in patterns))
