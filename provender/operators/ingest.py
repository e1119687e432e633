"""Seven purchase layouts into one. A loader takes a frame of text columns, named as in the export, and gives the standard
columns; every rule is an expression, so a load is one projection over the scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.functions import text as t
from provender.operators.weights import COMPUTED, REPORTED, TABLE, by_count, cascade, first_match

STANDARD = ["raw_name", "vendor", "brand", "total_price", "total_weight_lbs", "weight_source", "sustainable_yn", "sustainability_certifications", "purchase_type"]
# Words of rows that are no food.
NON_FOOD = ["NAPKIN", "GLOVE", "LID", "UNIFORM"]
WATER = ["Bubly", "Spring Water", "Mineral Water", "Bottled Water", "Water Bottled", "Aquafina", "Voss"]
PERSONAL = ["GLUE", "CHAPSTICK", "NEOSPORIN", "VISINE", "OINTMENT", "LOTION", "DEODORANT", "SHAMPOO", "TOOTHPASTE", "MOUTHWASH", "BAND-AID", "TYLENOL", "ADVIL", "ALEVE", "COUGH DROP"]
CHEMICAL = ["CHEM", "WAXIE", "CLEANER", "CLEANING", "SANITIZER", "DETERGENT", "DEGREASER", "DELIMER", "SOAP", "ANTIBACTERIAL", "DISENFECTANT", "DISINFECTANT"]
JANITORIAL = ["QUILON", "PAN LINER", "LINER TRASH", "CAN LINER", "REL LINER", "SANITARY LINER", "LINERS", "TOILET", "HAIRNET", "APRON", "UTENSIL", "FRESHENER", "THERMOMETER", "TONGS", "MITT", "STIRRER", "DOMINION", "ICE SCOOP", "SPONGE", "MOP", "SCOUR", "SCRUB", "BROOM", "DUSTPAN", "TOWEL", "WIPER", "STAPLES", "COMPOST", "COMPOSTABLE", "COMPOST34X48", "COMPOST47X60"]
DEPOSITS = ["DEPOSIT"]
EQUIPMENT = ["KNIFE", "FORK PLAS", "FORK WOOD", "BIO-BASED FORK", "PAPER FORK", "SW FORK", "WRAPPED FORK", "SPOON PLAS", "SPOON WOOD", "PAPER SPOON", "SW SPOON", "WRAPPED SPOON", "BOWL LEAF BAMBOO", "BOWL PAPER", "BOWL PULP", "FIBER BOWL", "SW BOWL", "TRAY FOOD", "FOOD TRAY", "TRAY PAPER", "PAPER TRAY", "CARRY TRAY", "HUHTAMAKI", "PAN RACK", "PAN FOIL", "DUST PAN", "BUN PAN", "CHOPSTICK", "CLING WRAP", "WRAP PAPER", "WRAP FOIL", "FILM WRAP"]
PACKAGING = ["LABEL ROLL", "SW LABEL", "SW LABELS", "PVC", "WITH WINDOW", "BAG PAPER", "FOIL ALMN", "FOIL ALUMINUM", "FOIL SHEET", "PAPER BOX PIZZA", "PAPER PICK"]
NOT_FOOD = NON_FOOD + WATER + PERSONAL + CHEMICAL + JANITORIAL + DEPOSITS + EQUIPMENT + PACKAGING
# Purchase units of money rows; units that mean one item a unit; a known typing error.
ROLLUP_UNITS = ["DOLR", "DOLR*", "DOLAR", "DOLLR*", "DLR"]
SINGLE_UNITS = ["CASE", "EACH", "JAR", "BAG", "BOX", "TUB", "PAIL", "BOTL", "ROLL", "TRY", "TRAY"]
PRICE_FIXES = [("Kikka Sushi", "GARDEN VEGETABLE SALAD ROLL", 9379.78)]
NOT_CANS = ["CONE CAKE #10 36/20CT", "MEAD ENVELOPES WHITE #10 50CT"]


@dataclass
class Dictionaries:
    """Rows in file order: patterns (pattern, lb), titles (title, lb), counts (pattern, lb, 'multiply' or 'case')."""

    patterns: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    titles: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    counts: dict[str, list[tuple[str, float, str]]] = field(default_factory=dict)

    def by_pattern(self, key: str, name: Column) -> Column:
        return first_match(name, [(p, float(w)) for p, w in self.patterns.get(key, [])]).cast("double")

    def by_title(self, key: str, name: Column) -> Column:
        """Exact titles; of a title that is there twice the last counts."""
        rows = list(dict(self.titles.get(key, [])).items())
        return F.create_map(*(F.lit(x) for r in rows for x in (r[0], float(r[1])))).getItem(name) if rows else F.lit(None).cast("double")

    def by_count(self, key: str, name: Column, count: Column) -> Column:
        return by_count(name, self.counts.get(key, []), count).cast("double")


def is_non_food(name: Column, words: list[str] | None = None) -> Column:
    return F.coalesce(name.rlike(rf"(?i)\b(?:{'|'.join(NOT_FOOD if words is None else words)})\b"), F.lit(False))


def split_non_food(rows: DataFrame, words: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(food, the rest); a missing name is food."""
    out = is_non_food(F.col("raw_name"), words)
    return rows.where(~out), rows.where(out)


def drop_rollups(raw: DataFrame, unit: str, item: str) -> DataFrame:
    """Without rows that count money (a missing unit stays) and without totals, which have no item."""
    return raw.where(~F.coalesce(t.known(F.col(f"`{unit}`")).isin(ROLLUP_UNITS), F.lit(False)) & t.known(F.col(f"`{item}`")).isNotNull())


def _get(name: str) -> Column:
    return t.known(F.col(f"`{name}`"))


def _standard(raw: DataFrame, weight: Column, **columns: Column) -> DataFrame:
    rows = raw.withColumn("_w", weight)
    known = {"raw_name": F.lit(None), "vendor": F.lit(None), "brand": F.lit(None).cast("string"), "sustainability_certifications": F.lit(None).cast("string"), "purchase_type": F.lit("purchasing")} | columns
    known |= {"total_weight_lbs": F.col("_w.weight"), "weight_source": F.col("_w.source")}
    return rows.select(*(known[c].alias(c) for c in STANDARD), *([F.col("ord")] if "ord" in raw.columns else []))


def _parsed(raw: DataFrame, **columns: Column) -> tuple[DataFrame, dict[str, Column]]:
    """raw with what is read from its cells as columns, so that rules that mention it don't parse anew; and the columns by name."""
    return raw.withColumns({f"_{k}": v for k, v in columns.items()}), {k: F.col(f"_{k}") for k in columns}


def _reported(weight: Column) -> Column:
    """A weight of zero is no weight."""
    return cascade((F.nullif(t.plain_number(weight), F.lit(0.0)), REPORTED))


def berkeley(raw: DataFrame, d: Dictionaries) -> DataFrame:
    cells = {"vendor": _get("Distributor"), "name": t.clean(_get("Product Name or Description ")), "pack": _get("Pack size"), "amount": t.strip(F.regexp_replace(_get(" Quantity sold "), ",", ""))}
    raw, c = _parsed(raw, **cells)
    vendor, name, pack, amount = (c[k] for k in cells)
    only = lambda names, w: F.when(vendor.isin(names), w)
    upper = F.upper(t.strip(pack))
    pieces, dry = t.number(pack, r"(?i)(\d+)\s*ct\b"), only(["Daylight Foods", "Peets", "JFC"], name)
    raw, c = _parsed(
        raw, qty=t.plain_number(amount), stated=t.number(amount, r"([\d.]+)\s*([A-Za-z]+)", 1), unit=F.lower(t.group(amount, r"([\d.]+)\s*([A-Za-z]+)", 2)), upper=upper, units=t.pack_units(pack), pieces=pieces, ounces=t.each_ounces_lb(name),
        wet=~name.rlike(t.NON_FOOD_VOLUME), in_case=F.when((vendor == "Sysco") & upper.endswith("CT"), pieces), pack_lb=only(["Sysco", "Pacific Seafood", "Bimbo Bakery"], t.pack_size_lb(pack)), named_lb=t.name_case_lb(dry),
        gallons=t.gallons(only(["Daylight Foods"], name)), named=t.name_count(only(["Daylight Foods"], name)), density=d.by_pattern("gal_density", name),
    )
    qty, stated, unit, upper, units, pieces, ounces, wet, in_case = (c[k] for k in ("qty", "stated", "unit", "upper", "units", "pieces", "ounces", "wet", "in_case"))
    counted = F.coalesce(d.by_count("count_based_food", name, in_case), d.by_count("sysco_ct_food", name, in_case))
    weight = cascade(
        (F.when(unit == "lb", stated).when(unit == "oz", stated / 16.0).when(unit == "kg", stated * 2.20462), REPORTED),
        (c["pack_lb"] * qty, COMPUTED),
        (only(["Allen Brothers", "Cream Co"], qty), COMPUTED),
        (c["named_lb"] * qty, COMPUTED),
        (only(["Bordanaves"], d.by_title("bordenaves", name) * t.pack_multiplier(pack, name) * qty), TABLE),
        (only(["Ben & Jerry's"], ounces * units * qty), COMPUTED),
        (only(["Ben & Jerry's"], d.by_pattern("benjerrys", name) * units * qty), TABLE),
        (only(["Kikka Sushi"], d.by_pattern("kikkasushi", name) * qty), TABLE),
        (only(["Bimbo Bakery"], d.by_title("bimbobakery", name) * pieces * qty), TABLE),
        (only(["Espostos"], d.by_pattern("espostos", name) * qty), TABLE),
        (only(["City Baking"], d.by_pattern("citybaking", name) * F.when(pack.rlike(r"^\s*[+-]?\d+\s*$"), t.plain_number(pack)) * qty), TABLE),
        (F.when((vendor == "Sysco") & (upper == "#10"), d.by_pattern("sysco_number10_can", name) * qty), TABLE),
        (F.when((vendor == "Sysco") & wet, c["density"] * t.number(pack, r"(?i)([\d.]+)\s*GAL") * qty), TABLE),
        (F.when((vendor == "Daylight Foods") & wet, c["density"] * c["gallons"]["value"] * qty), TABLE),
        (ounces * in_case * qty, COMPUTED),
        (F.when(in_case != 1, counted * qty), TABLE),
        (only(["Daylight Foods"], d.by_count("count_based_food", name, c["named"]["value"]) * qty), TABLE),
    )
    price = t.currency(_get(" Extended Price "))
    for who, what, fixed in PRICE_FIXES:
        price = F.when((vendor == who) & (name == what), fixed).otherwise(price)
    yn = t.recode(t.clean(_get("AASHE?")), {"Yes": "Y", "No": "N"})
    return _standard(raw, weight, raw_name=name, vendor=vendor, brand=t.clean(_get("Brand")), total_price=price, sustainable_yn=yn, sustainability_certifications=t.join_tags([_get("Certification"), _get("Cert")]))


def davis(raw: DataFrame, d: Dictionaries) -> DataFrame:
    qty = t.plain_number(_get("Total Quantity Purchased"))
    pounds = F.coalesce(F.upper(t.strip(_get("Item UOM (e.g.LB)"))) == "LB", F.lit(False))
    each = t.plain_number(_get("Item Weight (e.g.5)")) * t.plain_number(_get("Pack Size (e.g.4)")) * qty
    source = F.when(pounds, REPORTED).otherwise(COMPUTED)
    weight = cascade((F.when(pounds, qty), REPORTED), (F.when(~pounds, each), COMPUTED), otherwise=source)
    stars = _get("STARS Certification")
    yn = F.when(stars.isNull(), "NA").when(t.strip(stars) == "No", "N").otherwise("Y")
    tags = t.join_tags([_get(c) for c in ("Sustainable Farming", "Sustainable Agriculture", "Humane Animal Care", "Sustainable Seafood", "Fair Trade / Labor")])
    return _standard(raw, weight, raw_name=t.clean(_get("Name")), vendor=_get("Distributor Name (delivering entity)"), brand=t.clean(_get("Brand Name (if different from Column F)")), total_price=t.currency(_get("Total Spend")), sustainable_yn=yn, sustainability_certifications=tags)


def davis_health(raw: DataFrame, d: Dictionaries) -> DataFrame:
    cert = t.clean(_get("env_type_cert"))
    return _standard(raw, _reported(_get("weight_lb")), raw_name=t.clean(_get("Name")), vendor=_get("supplier"), brand=t.clean(_get("Brand")), total_price=t.currency(_get(" total_cost ")), sustainable_yn=F.when(cert.isNotNull(), "Y").otherwise("N"), sustainability_certifications=cert)


def los_angeles_health(raw: DataFrame, d: Dictionaries) -> DataFrame:
    cert = t.clean(_get("env_type_cert"))
    cert = F.when(~F.lower(cert).isin(t.DIET_TAGS[1:]), cert)
    yn = t.recode(t.clean(_get("env_defined_type")), {"Sustainable": "Y", "Conventional": "N"})
    return _standard(raw, _reported(_get("weight")), raw_name=t.clean(_get("notes")), vendor=_get("supplier"), brand=t.clean(_get("brand")), total_price=t.currency(_get("total_cost")), sustainable_yn=yn, sustainability_certifications=cert)


def san_diego_health(raw: DataFrame, d: Dictionaries) -> DataFrame:
    yn = t.recode(t.clean(_get("Sustainable?")), {"Sustainable": "Y", "Conventional": "N"})
    return _standard(raw, _reported(_get("weight")), raw_name=t.clean(_get("ProductName")), vendor=t.clean(_get("Distributor")), brand=t.clean(_get("Supplier")), total_price=t.currency(_get("total_cost")), sustainable_yn=yn, sustainability_certifications=t.clean(_get("Certification")))


def santa_cruz(raw: DataFrame, d: Dictionaries) -> DataFrame:
    """The export's first line is junk; the reader has dropped it."""
    name, unit = t.clean(_get("Product Description")), F.upper(t.strip(_get("Unit\nType")))
    total, bought, units = (t.plain_number(_get(c)) for c in ("Total units ordered", "Units\nPurchased", "Units"))
    direct = F.when(unit.isin("LB", "LBS", "LB AVG"), total).when(unit == "OZ", total / 16.0).when(unit.isin("G", "GM", "GR"), total * 0.00220462).when(unit == "KG", total * 2.20462)
    counted = unit.isin("CT", "EA", "EACH", "PK", "CN", "CAN", "DOZ", "LOAF") & name.startswith("PROD ")
    trusted = (units <= 200) & ~F.upper(name).contains("APPROX WT")
    rows = [(p, F.lit(float(w)) * bought if f == "case" else F.when(trusted, F.lit(float(w)) * total)) for p, w, f in d.counts.get("count_based_food", [])]
    weight = cascade((direct, REPORTED), (F.when(counted, first_match(name, rows)).cast("double"), TABLE))
    yn = t.recode(t.clean(_get("STARS 3.0 Cert")), {"✅": "Y", "❌": "N"})
    return _standard(raw, weight, raw_name=name, vendor=_get("Vendor"), brand=t.clean(_get("Label/Brand")), total_price=t.currency(_get("Cost")), sustainable_yn=yn)


def riverside(raw: DataFrame, d: Dictionaries) -> DataFrame:
    raw = drop_rollups(raw, "Purchase Unit", "Item")
    raw, c = _parsed(raw, name=t.clean(_get("Name")), vendor=_get("Vendor"), price=t.currency(_get(" Total Spend ")), units=t.plain_number(_get("Units")), unit=F.regexp_replace(F.upper(t.strip(_get("Purchase Unit"))), r"\*+$", ""))
    name, vendor, price, units, unit = (c[k] for k in ("name", "vendor", "price", "units", "unit"))
    raw, c = _parsed(
        raw, per_case=t.number(unit, r"^(\d+(?:\.\d+)?)\s*/\s*CS$"), in_name=t.name_weight(name), ounces=t.each_ounces_lb(name), wet=~name.rlike(t.NON_FOOD_VOLUME), tray=t.number(unit, r"^(\d+)CT\*?$"), sure=F.coalesce(F.when(unit == "DOZ", 12.0), t.number(unit, r"^(\d+)\s*CT\*?(?:-CS)?$")),
        gallons=t.gallons(name), liters=t.liters_as_gallons(name), grams=t.grams_as_pounds(name), density=d.by_pattern("gal_density", name), counted=t.name_count(name), packed=t.number(unit, r"^CS(\d+)$"),
    )
    at_least = lambda w: F.when(w >= t.MIN_CASE_LB, w)
    per_case, in_name, ounces, wet, gallons, liters, grams, density, n = (c[k] for k in ("per_case", "in_name", "ounces", "wet", "gallons", "liters", "grams", "density", "counted"))
    case = F.when(unit.isin(SINGLE_UNITS), 1.0).otherwise(per_case)
    shape, value = in_name["shape"], in_name["value"]
    other = F.when(name.rlike("(?i)LE CHEF") & unit.isin("TRY", "TRAY"), 6.0).otherwise(c["tray"])
    cheap = lambda w: t.plausible(w, price)
    whole = lambda s, mult: F.when(s["shape"] == "chain", s["value"]).when(s["shape"] == "bare", s["value"] * mult)
    unit_gallons = F.when(unit == "GAL", 1.0).otherwise(F.coalesce(t.number(unit, rf"^({t.NUMBER})\s*/\s*({t.NUMBER})\s*GAL$", 1) * t.number(unit, rf"^({t.NUMBER})\s*/\s*({t.NUMBER})\s*GAL$", 2), t.number(unit, rf"^({t.NUMBER})\s*GAL$")))
    each = F.when(unit == "EACH", 1.0).otherwise(per_case)
    gram_lb = whole(grams, each)
    gram_lb = F.when(((grams["shape"] == "chain") | (each != 1.0)) & (gram_lb < t.MIN_CASE_LB), F.lit(None)).otherwise(gram_lb)
    can = F.when(name.rlike(r"#10\b") & ~name.isin(NOT_CANS), F.coalesce(per_case, t.number(name, r"(\d+)\s*/\s*#10\b"), F.lit(1.0)))
    # counts: the name's own; else, without one, what the unit says
    counted = F.when(n["shape"] == "chain", n["value"]).when(n["shape"] != "none", n["value"] * F.coalesce(per_case, F.lit(1.0)))
    sure = c["sure"]
    guess = F.coalesce(per_case, c["packed"], F.when(F.upper(name).contains("LE CHEF") & unit.isin("TRY", "TRAY"), 6.0))
    bare = F.when(unit.isin("EACH", "LOAF"), 1.0)
    tables = d.counts.get("sysco_ct_food", []) + d.counts.get("ucr_count_food", [])

    def count_rule(ref: float, formula: str) -> Column:
        if formula == "case":
            return F.lit(float(ref)) * units
        w = lambda c: F.lit(float(ref)) * c * units
        guessed = F.when(w(guess) > 0, t.plausible(w(guess), price, null_price=False))
        return F.when(n["shape"] != "none", w(counted)).when(sure.isNotNull(), w(sure)).when(guess.isNotNull(), guessed).otherwise(w(bare))

    eggs = F.when(name.rlike("(?i)EGG"), F.coalesce(t.dozen_count(name), counted)) * 0.125
    weight = cascade(
        (F.when(unit == "LB", units), REPORTED),
        (t.number(unit, rf"^({t.NUMBER})#") * units, COMPUTED),
        (t.number(unit, rf"^({t.NUMBER})\s*LB$") * units, COMPUTED),
        (F.when(shape == "chain", at_least(value)) * units, COMPUTED),
        (F.when(shape == "bare", at_least(value * case)) * units, COMPUTED),
        (F.when(unit == "EACH", ounces) * units, COMPUTED),
        (F.when(shape == "none", cheap(at_least(ounces * per_case) * units)), COMPUTED),
        (F.when(shape == "none", cheap(at_least(ounces * other) * units)), COMPUTED),
        (F.when(wet, density * unit_gallons * units), TABLE),
        (F.when(wet, density * whole(gallons, case) * units), TABLE),
        (F.when(wet, density * whole(liters, case) * units), TABLE),
        (F.when(name.rlike("(?i)BIB"), density * t.number(name, rf"({t.NUMBER})\s*-?\s*G\b") * units), TABLE),
        (F.when(wet, gram_lb * units), COMPUTED),
        (d.by_pattern("sysco_number10_can", name) * can * units, TABLE),
        (F.when(vendor == "Sysco", d.by_title("sysco_cross_campus", F.upper(name))) * units, TABLE),
        (first_match(name, [(p, count_rule(w, f)) for p, w, f in tables]).cast("double"), TABLE),
        (eggs * units, TABLE),
        otherwise=F.when(unit == "LB", REPORTED).otherwise("unresolved"),
    )
    cert = t.clean(_get("Sustainability"))
    return _standard(raw, weight, raw_name=name, vendor=vendor, total_price=price, sustainable_yn=F.when(cert.isNotNull(), "Y").otherwise("N"), sustainability_certifications=cert)


LOADERS = {"UCB": berkeley, "UCD": davis, "UCD_H": davis_health, "UCLA_H": los_angeles_health, "UCR": riverside, "UCSC": santa_cruz, "UCSD_H": san_diego_health}


def load_all(raws: dict[str, DataFrame], d: Dictionaries, campuses: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(food, non-food) of all exports that are there, with campus and campus_type in front, in the loaders' order.

    campuses: abbreviation to (name, type).
    """
    food = other = None
    for i, (abbreviation, loader) in enumerate(LOADERS.items()):
        if abbreviation not in raws:
            continue
        campus, kind = campuses[abbreviation]
        parts = [x.select(F.lit(campus).alias("campus"), F.lit(kind).alias("campus_type"), F.lit(i).alias("campus_ord"), "*") for x in split_non_food(loader(raws[abbreviation], d))]
        food, other = (parts[0], parts[1]) if food is None else (food.unionByName(parts[0]), other.unionByName(parts[1]))
    return food, other
