"""Row predicates over the ERP relations."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from werkbank.functions import constants as K
from werkbank.functions.text import listed_name, matches, matches_any, same_text

_ATTRIBUTES = (
    "sku", "ean", "producer_ean", "category", "item_name", "ram_capacity", "ram_ddr", "ram_speed",
    "cpu_manufacturer", "cpu_generation", "cpu_model", "hdd_capacity", "hdd_type",
    "case_manufacturer", "case_model", "gpu_manufacturer", "gpu_series", "gpu_model", "gpu_vram")

# attribute prefix -> the category that it implies
_IMPLIED = {"ram_": "ME", "hdd_": "HD", "cpu_": "CP", "case_": "TW", "gpu_": "GC"}


def article_arguments(**given) -> dict:
    """Checked article attributes: blanks dropped, category and maker filled in, case names
    spelled as in the reference list. Contradictions raise ``ValueError``."""
    unknown = set(given) - set(_ATTRIBUTES)
    if unknown:
        raise ValueError(f"unknown article attributes: {sorted(unknown)}")
    for name in ("ean", "producer_ean"):
        if given.get(name) is not None and (
                not isinstance(given[name], str) or not given[name].strip()):
            raise ValueError(f"{name} is blank")
    args = {k: v for k, v in given.items() if v is not None and v != ""}
    if not args:
        raise ValueError("an article search without any attribute would match every article")
    if "category" in args:
        args["category"] = args["category"].strip().upper()
    for prefix, category in _IMPLIED.items():
        if any(name.startswith(prefix) for name in args):
            if args.setdefault("category", category) != category:
                raise ValueError(f"{prefix}* filters need category {category}")
    for needs, maker in (("gpu_model", "gpu_manufacturer"), ("cpu_model", "cpu_manufacturer"),
                         ("cpu_generation", "cpu_manufacturer"),
                         ("case_model", "case_manufacturer")):
        if needs in args and maker not in args:
            raise ValueError(f"{needs} is only known together with {maker}")
    if "gpu_series" in args:
        maker = "AMD" if args["gpu_series"] == "Radeon" else "NVIDIA"
        if args.setdefault("gpu_manufacturer", maker) != maker:
            raise ValueError(f"{args['gpu_series']} cards are not made by {args['gpu_manufacturer']}")
    if "cpu_model" in args:
        model = str(args["cpu_model"]).strip().upper()
        if not re.fullmatch(r"\d+([A-Z][A-Z0-9]*)?", model) or int(re.match(r"\d+", model)[0]) == 0:
            raise ValueError(f"{args['cpu_model']!r} is no model number (digits, then perhaps letters)")
        args["cpu_model"] = model
    if args.get("cpu_generation", 1) <= 0:
        raise ValueError("CPU tiers count from 1")
    if "case_manufacturer" in args:
        makers = {maker.casefold(): maker for maker in K.CASE_MODELS}
        maker = makers.get(args["case_manufacturer"].strip().casefold())
        if maker is None:
            raise ValueError(f"the case list has no maker {args['case_manufacturer']!r}")
        args["case_manufacturer"] = maker
        if "case_model" in args:
            models = {model.casefold(): model for model in K.CASE_MODELS[maker]}
            model = models.get(args["case_model"].strip().casefold())
            if model is None:
                raise ValueError(f"{maker} has no case {args['case_model']!r} in the list")
            args["case_model"] = model
    return args


def _name_patterns(args: dict) -> list[list[str]]:
    """Alternatives of LIKE patterns on the article name; the outer list is ANDed."""
    get = args.get
    exact_or_longer = lambda name: [name, f"{name} %"]
    category, found = get("category"), []
    if category == "ME":
        found += [[f"{args['ram_capacity']}GB%"]] if "ram_capacity" in args else []
        found += [[f"%DDR{args['ram_ddr']}%"]] if "ram_ddr" in args else []
        found += [[f"%{args['ram_speed']}%"]] if "ram_speed" in args else []
    elif category == "CP" and get("cpu_manufacturer"):
        intel, tier, model = args["cpu_manufacturer"] == "Intel", get("cpu_generation"), get("cpu_model")
        any_tier = "%" if tier is None else tier
        if model and intel:
            found.append(exact_or_longer(f"Intel Core i{any_tier}-{model}")
                         + exact_or_longer(f"Intel Core Ultra {any_tier} {model}"))
        elif model:
            found.append(exact_or_longer(f"AMD Ryzen {any_tier} {model}"))
        elif tier is not None:
            found.append([f"Intel Core i{tier}-%" if intel else f"AMD Ryzen {tier} %"])
        else:
            found.append(["Intel Core %" if intel else "AMD Ryzen %"])
    elif category == "HD" and get("hdd_type"):
        # a capacity without a type restricts nothing but the category
        size = get("hdd_capacity")
        found.append([f"{size}Gb {args['hdd_type']}%" if size else f"%{args['hdd_type']}%"])
    elif category == "TW" and get("case_manufacturer"):
        maker, model = args["case_manufacturer"], get("case_model")
        found.append(exact_or_longer(f"{maker} {model}") if model else [f"{maker} %"])
    elif category == "GC":
        # the series restricts nothing beyond the maker that it implies
        if get("gpu_manufacturer"):
            found.append(["Radeon %"] if args["gpu_manufacturer"] == "AMD"
                         else ["Geforce %", "Quadro %", "Nvidia %"])
        if get("gpu_model"):
            found.append([f"%{args['gpu_model']}%"])
        vram = get("gpu_vram")
        if vram:
            found.append([f"%{vram}GB%" if vram > 2 else "%1024MB%" if vram == 1 else "%2048MB%"])
    return found


def article_predicate(**attributes) -> Column:
    """Condition on ``ART`` for a set of article attributes, all ANDed."""
    args = article_arguments(**attributes)
    conditions = []
    for name, column in (("ean", "EANNummer"), ("producer_ean", "HstArtikelnummer")):
        if name in args:
            conditions.append(same_text(F.col(column), args[name].strip()))
    for name, column in (("sku", "Artikelnummer"), ("category", "ArtikelGruppe"),
                         ("item_name", "Bezeichnung")):
        if name in args:
            conditions.append(matches(F.col(column), f"%{args[name].strip()}%"))
    for alternatives in _name_patterns(args):
        conditions.append(matches_any(F.col("Bezeichnung"), alternatives))
    return reduce(and_, conditions)


def component_alternatives(components: list) -> Column:
    """Any of the components; each is a partial SKU or a dict of attributes. None = all."""
    if not components:
        return F.lit(True)
    return reduce(or_, [article_predicate(**({"sku": c} if isinstance(c, str) else c))
                        for c in components])


def _sales_channel() -> Column:
    return (~F.col("Vertreter").isin(*K.INTERNAL_CHANNELS)
            & (F.col("PLZ") != K.INTERNAL_POSTCODE)
            & (F.col("Vertrag") != K.INTERNAL_CONTRACT)
            & (F.col("Lager") == K.SALES_WAREHOUSE))


def genuine_orders(variant: str) -> Column:
    """Document headers of real customers, as each report defines them. NULL in a tested
    column drops the row."""
    if variant == "list":
        return _sales_channel() & (F.col("Adressnummer") != K.INTERNAL_CUSTOMER)
    if variant == "analysis":
        return _sales_channel() & (F.col("Netto") != 0)
    if variant == "co_purchase":
        return _sales_channel() & (F.col("Belegtyp") == "R")
    if variant == "email":
        return ((F.col("Belegtyp") == "R") & (F.col("PLZ") != K.INTERNAL_POSTCODE)
                & (F.col("Vertrag") != K.INTERNAL_CONTRACT) & (F.col("Lager") == K.SALES_WAREHOUSE)
                & (F.col("Netto") != 0) & F.col("_EMAIL1").isNotNull()
                & (F.col("Vertreter") == K.OWN_SHOP_CHANNEL))
    if variant == "open":
        return (~F.col("Adressnummer").isin(*K.INTERNAL_WORKSHOP_CUSTOMERS)
                & (F.col("Vorlage") == "") & (F.col("Belegtyp") == "L") & (F.col("Status") == 0))
    raise ValueError(f"unknown variant: {variant}")


def name_matches(value: str) -> Column:
    """Customer text in 'last first', 'first last', the last or the first name."""
    pattern = f"%{value.strip()}%"
    last, first = F.col("Name"), F.col("Vorname")
    return (matches(listed_name(last, first), pattern) | matches(listed_name(first, last), pattern)
            | matches(last, pattern) | matches(first, pattern))


def lifecycle(state: str | None = None, document_type: str | None = None,
              status: int | str | None = None) -> tuple[str, int | None]:
    """(type, status) of a lifecycle state, or of the plain arguments with type ``R`` as the
    default. A contradiction raises ``ValueError``."""
    status = None if status is None or status == "" else int(status)
    if not state:
        return document_type or "R", status
    if state not in K.LIFECYCLE:
        raise ValueError(f"unknown lifecycle state: {state}")
    wanted = K.LIFECYCLE[state]
    if (document_type or wanted[0]) != wanted[0] or (wanted[1] if status is None else status) != wanted[1]:
        raise ValueError(f"lifecycle_state={state!r} requires type {wanted[0]} and status {wanted[1]}")
    return wanted


def delivery_status(status: str | None = None) -> Column:
    """Open sign of a purchase document: waiting < 0, received >= 0, unknown excluded."""
    sign = F.col("UebernahmeOffen")
    if status is None:
        return sign.isNotNull()
    if status not in ("waiting", "received"):
        raise ValueError(f"a delivery is waiting or received, not {status!r}")
    return sign < 0 if status == "waiting" else sign >= 0


def visible_messages() -> Column:
    return F.col("visible") & (F.length("body") > 0)
