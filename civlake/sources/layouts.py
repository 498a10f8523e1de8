"""County ballot layouts as rows of one interchange layout: what each Board's lists say, by their own columns.

Every function takes landed rows with all columns as text (and `seq`, the order of the rows in their files) and gives the columns of
PLATFORM. A voter's rows become one by the Board's own rule, as an aggregate by voter. Dates are m/d/yyyy, as the layout has them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civlake.functions.columns import ANY_DAY, all_of, clean, iso_date, with_iso_dates
from civlake.functions.display import APP_TYPES, CHALLENGES, PARTIES, VAULT_TYPES, coded
from civlake.functions.names import city_state_zip, split_name
from civlake.operators.ingest import match_persons
from civlake.operators.ranking import best_row, majority
from civlake.scratch import stashed

#: The interchange layout's columns (fixed values).
PLATFORM = "LASTN FIRSTN MIDDLEN SUFFIXN PARTYAFFIL CNTYIDNUM AVADDR1 AVADDR2 CITY STATE ZIPCODE COUNTRY AVSENTDATE AVRECVDATE AVRECVMETH AVAPPTYPE PRECNAME AVAPPDATE AVBALSTAT SOURCE".split()
#: Parties as Boards write them (fixed values); what is not listed stays.
PARTY_WORDS = {"UNAFFILIATED": "", "NON": "", "NOPTY": "", "NO PARTY": "", "NP": "", "REPUBLICAN": "REP", "DEMOCRATIC": "DEM", "LIBERTARIAN": "LIB", "GREEN": "GRE", "GRN": "GRE", "U": "", "N": "", "D": "DEM", "R": "REP", "L": "LIB", "G": "GRE"}
#: Return methods by a validity code's suffix, and flags by its base (fixed values).
RETURN_METHODS = {"M": "MAILED", "P": "O T C/ PERSONAL DELIVERY", "D": "DROP BOX"}


def _c(name: str) -> Column:
    return clean(F.col(f"`{name}`"))


def _upper(name: str) -> Column:
    return F.upper(_c(name))


def _party(name: str) -> Column:
    return coded(F.col(f"`{name}`"), PARTY_WORDS)


def mdy(text: Column) -> Column:
    """m/d/yyyy without leading zeroes from m/d/y, m/d/yyyy, either with a time behind, and yyyy-mm-dd; empty for anything else."""
    s = clean(text)
    us, iso = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?:\D.*)?$", r"^(\d{4})-(\d{2})-(\d{2})(?:\D.*)?$"
    bare = lambda c: c.try_cast("int").cast("string")
    y = F.regexp_extract(s, us, 3)
    from_us = F.concat_ws("/", bare(F.regexp_extract(s, us, 1)), bare(F.regexp_extract(s, us, 2)), F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y))
    from_iso = F.concat_ws("/", bare(F.regexp_extract(s, iso, 2)), bare(F.regexp_extract(s, iso, 3)), F.regexp_extract(s, iso, 1))
    return F.when(y != "", from_us).when(s.rlike(iso), from_iso).otherwise("")


def _whole(name: str) -> Column:
    """A voter's number without leading zeroes; null if it is none."""
    return F.when(_c(name).rlike(r"^\d+$"), _c(name).try_cast("long"))


def platform(df: DataFrame, **columns: Column) -> DataFrame:
    """The interchange columns, empty where nothing is given; rows without a voter's number are left out."""
    text = lambda c: F.coalesce(columns[c].cast("string"), F.lit("")) if c in columns else F.lit("")
    return df.filter(columns["CNTYIDNUM"].isNotNull()).select(*[text(c).alias(c) for c in PLATFORM])


def _address(line: Column) -> dict[str, Column]:
    p = city_state_zip(line)
    return {"CITY": p["city"], "STATE": p["state"], "ZIPCODE": p["zip"]}


def _named(name: Column) -> dict[str, Column]:
    n = split_name(name)
    return {"LASTN": n["last"], "FIRSTN": n["first"], "MIDDLEN": n["middle"], "SUFFIXN": n["suffix"]}


def _foreign(name: str) -> Column:
    return F.when(_upper(name).isin("", "US", "USA", "UNITED STATES"), "").otherwise(_upper(name))


def election_vault(in_person: DataFrame, mail: DataFrame) -> DataFrame:
    """Both lists of a vault with one header: who voted in the office, and who was sent a ballot. Who is in both has a row of each; the mail row comes last."""

    def rows(df: DataFrame, sent: str, app: Column, way: Column, status: Column, source: str) -> DataFrame:
        back = mdy(F.col("`BALLOT RETURNED`"))
        returned = back != ""
        return platform(
            df, LASTN=_c("LAST NAME"), FIRSTN=_c("FIRST NAME"), PARTYAFFIL=_party("PARTY"), CNTYIDNUM=_whole("VOTER ID"), AVADDR1=_c("ADDRESS"), CITY=_c("CITY"), STATE=_c("STATE"), ZIPCODE=F.substring(_c("ZIP"), 1, 5),
            AVSENTDATE=mdy(F.col(f"`{sent}`")), AVRECVDATE=back, AVRECVMETH=F.when(returned, way).otherwise("NOT RECEIVED"), AVAPPTYPE=app, PRECNAME=F.split(_c("PRECINCT"), r"\.")[0], AVAPPDATE=_c("REQUESTED DATE"),
            AVBALSTAT=F.when(returned, status), SOURCE=F.lit(source),
        )

    office = F.lit("IN OFFICE")
    return rows(in_person, "BALLOT ISSUED", office, office, F.lit("VALID"), "in-person").unionByName(rows(mail, "BALLOT MAILED", coded(F.col("TYPE"), VAULT_TYPES), F.lit("MAIL"), coded(F.col("`CHALLENGE CODE`"), CHALLENGES), "mail"))


def election_vault_long(in_person: DataFrame, mail: DataFrame) -> DataFrame:
    """The vault's other header, with local ids and up to four address lines."""

    def rows(df: DataFrame, sent: Column, back: Column, office: Column, status: Column, asked: Column, source: str) -> DataFrame:
        kind = F.when(office, "IN OFFICE").otherwise("MAIL")
        lines = F.array_join(F.filter(F.array(*[_c(f"ADDRESS LINE {k}") for k in (2, 3, 4)]), lambda x: x != ""), " ")
        return platform(
            df, LASTN=_c("LAST NAME"), FIRSTN=_c("FIRST NAME"), MIDDLEN=_c("MIDDLE NAME"), SUFFIXN=_c("SUFFIX NAME"), PARTYAFFIL=_party("PARTY"), CNTYIDNUM=_whole("LOCAL_ID"), AVADDR1=_c("ADDRESS LINE 1"), AVADDR2=lines,
            CITY=_c("CITY"), STATE=_c("STATE"), ZIPCODE=F.substring(_c("ZIP"), 1, 5), AVSENTDATE=sent, AVRECVDATE=back, AVRECVMETH=F.when(back != "", kind).otherwise("NOT RECEIVED"), AVAPPTYPE=kind, PRECNAME=_c("PRECINCT_NAME"),
            AVAPPDATE=asked, AVBALSTAT=F.when(back != "", status), SOURCE=F.lit(source),
        )

    voted = mdy(F.col("`DATE VOTED`"))
    one = rows(in_person, voted, voted, F.lit(True), F.lit("VALID"), voted, "in-person")
    two = rows(mail, mdy(F.col("`DATE MAILED`")), mdy(F.col("`DATE RETURNED`")), _upper("MAILED") == "I", coded(F.col("`VAL/REJECTED`"), CHALLENGES), mdy(F.col("DATE_REQUESTED")), "mail")
    return one.unionByName(two)


def in_both_lists(rows: DataFrame) -> DataFrame:
    """One row: how many voters have a row of either list."""
    return rows.groupBy("CNTYIDNUM").agg(F.count_distinct("SOURCE").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("both"))


def _application(category: Column, org: Column) -> Column:
    """The application type of a tracking report's category and office; both joined if they are not known."""
    c, o = F.upper(category), F.upper(org)
    return (
        F.when(c.isin("PAPER", "EV", "EVOFF") | (o == "OFF"), "IN OFFICE")
        .when((c == "CRB") | (o == "CURB"), "CURBSIDE")
        .when(c == "NH", "NURSING HOME")
        .when((c == "HOME") | o.isin("HAND", "HCO"), "HAND CARRY")
        .when(c.isin("CO", "MI", "MIL") & (o == "EML"), "UOCAVA EMAIL")
        .when(c == "CO", "CIVILIAN OVERSEAS")
        .when(c.isin("MI", "MIL"), "MILITARY")
        .when(c == "DS", "ACCESSIBLE BALLOT")
        .when((c == "NF") | (o == "MAIL"), "MAIL")
        .otherwise(F.concat_ws("|", category, org))
    )


def requests_and_returns(mailing: DataFrame, tracking: DataFrame) -> DataFrame:
    """A report of requests, the latest of each voter (the first of equals), joined in full with one of returns, the last row of each voter."""
    asked = mailing.withColumn("id", _whole("Voter ID")).filter("id is not null").withColumn("issued", mdy(F.col("`Date Entered`")))
    m = best_row(asked, ["id"], [iso_date(F.col("issued")), -F.col("seq")])
    t = best_row(tracking.withColumn("id", _whole("Voter ID")).filter("id is not null"), ["id"], [F.col("seq")])
    m = m.select("id", F.col("issued"), *[x.alias(f"m_{c}") for c, x in {**_named(F.col("Name")), "PARTYAFFIL": _party("Party"), "AVADDR1": F.trim(F.concat_ws(" ", _upper("Address"), _upper("Apt Number"))), "CITY": _upper("City"), "STATE": F.substring(_upper("State"), 1, 2), "ZIPCODE": F.substring(_c("Zip"), 1, 5), "PRECNAME": _c("Precinct")}.items()])
    t = t.select("id", mdy(F.col("Returned")).alias("ret"), mdy(F.col("Issued")).alias("t_issued"), _application(_c("Category"), _c("Org")).alias("app"), F.concat_ws("|", _c("Category"), _c("Org")).alias("code"), F.upper(_c("Org")).contains("HAND").alias("hand"), *[x.alias(f"t_{c}") for c, x in {**_named(F.col("Name")), "PARTYAFFIL": _party("Party"), "AVADDR1": _upper("Mailed To"), **_address(F.col("`City State Zip`")), "PRECNAME": _c("Precinct")}.items()])
    both = m.join(t, "id", "full_outer")
    issued = F.coalesce(F.nullif("issued", F.lit("")), "t_issued")
    app = F.coalesce("app", F.lit("MAIL"))
    way = F.when(app.isin("IN OFFICE", "CURBSIDE"), "CAST IN PERSON").when(F.col("hand"), "O T C/ PERSONAL DELIVERY").otherwise("MAILED")
    back = F.coalesce("ret", F.lit("")) != ""
    same = {c: F.coalesce(f"m_{c}", f"t_{c}") for c in ("LASTN", "FIRSTN", "MIDDLEN", "SUFFIXN", "PARTYAFFIL", "AVADDR1", "CITY", "STATE", "ZIPCODE", "PRECNAME")}
    return platform(both, **same, CNTYIDNUM=F.col("id"), AVSENTDATE=issued, AVRECVDATE=F.col("ret"), AVRECVMETH=F.when(back, way).otherwise("NOT RECEIVED"), AVAPPTYPE=app, AVAPPDATE=issued, AVBALSTAT=F.when(back, "VALID"), SOURCE=F.coalesce("code", F.lit("requested")))


def sheets_and_returns(sheets: list[DataFrame], returned: DataFrame, ids: DataFrame) -> DataFrame:
    """All sheets of requests, overlaid by the cumulative list of returns, for voters whose state id has a county id in `ids` (sos, county).

    Rows have id (the state's), last, first, party, cat, type, entered or returned, csz, street, precinct. A return without a request counts as sent on its day.
    """
    state = F.upper(_c("id"))
    requests = reduce(DataFrame.unionByName, sheets).withColumn("id", state).filter(F.col("id").rlike(r"^OH\d+$"))
    back = returned.withColumn("id", state).filter(F.col("id").rlike(r"^OH\d+$"))
    fields = ("last", "first", "party", "cat", "type", "street", "csz", "precinct")
    r = best_row(requests, ["id"], [F.col("seq")]).select("id", mdy(F.col("entered")).alias("sent"), *[F.col(c).alias(f"r_{c}") for c in fields])
    b = best_row(back, ["id"], [F.col("seq")]).select("id", mdy(F.col("returned")).alias("ret"), *[F.col(c).alias(f"b_{c}") for c in fields])
    met = r.join(b, "id", "full_outer").join(ids.select(F.col("sos").alias("id"), "county"), "id")
    met = met.select("id", "county", "ret", F.coalesce(F.nullif("sent", F.lit("")), "ret").alias("sent"), *[F.coalesce(f"b_{c}", f"r_{c}").alias(c) for c in fields])
    app = F.when(_upper("type").isin("OFF", "EV"), "IN OFFICE").otherwise("MAIL")
    has = F.coalesce("ret", F.lit("")) != ""
    return platform(
        met, LASTN=_upper("last"), FIRSTN=_upper("first"), PARTYAFFIL=_party("party"), CNTYIDNUM=F.col("county"), AVADDR1=_upper("street"), **_address(F.col("csz")), AVSENTDATE=F.col("sent"), AVRECVDATE=F.col("ret"),
        AVRECVMETH=F.when(has, F.when(app == "IN OFFICE", "CAST IN PERSON").otherwise("MAILED")).otherwise("NOT RECEIVED"), AVAPPTYPE=app, PRECNAME=_c("precinct"), AVAPPDATE=F.col("sent"), AVBALSTAT=F.when(has, "VALID"), SOURCE=F.concat_ws("/", "cat", "type"),
    )


def unmatched_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose state id has no county id."""
    return rows.withColumn("id", F.upper(_c("id"))).join(ids.select(F.col("sos").alias("id")), "id", "left_anti")


def daily_files(rows: DataFrame) -> DataFrame:
    """Daily files by column position (cells c0 to c17, file and seq): of a voter the row that is returned, then the latest, then of the last file, there the first. A blank method is in person if sent and returned at the same moment."""
    moment = lambda c: F.coalesce(F.date_format(F.timestamp_seconds(F.floor((F.col(c).try_cast("double") - 25569) * 86400 + 0.5)), "yyyy-MM-dd HH:mm:ss"), F.nullif(iso_date(mdy(F.col(c))), F.lit("")))
    r = rows.withColumn("id", _whole("c1")).filter("id is not null").withColumn("sent", moment("c15")).withColumn("ret", moment("c16")).withColumn("app", moment("c14"))
    best = best_row(r, ["id"], [F.col("ret").isNotNull(), F.coalesce("ret", "sent", F.lit("")), F.col("file"), -F.col("seq")])
    way = F.coalesce(F.nullif(_upper("c17"), F.lit("")), F.when(F.col("ret").eqNullSafe(F.col("sent")) & F.col("ret").isNotNull(), "IN PERSON").otherwise("MAIL"))
    app = coded(way, {"IN PERSON": "IN OFFICE", "MAIL": "MAIL", "UOCAVA": "UOCAVA MAIL", "CARRY OUT": "HAND CARRY"})
    country = F.when((_c("c8") != "") & ~_c("c8").rlike(r"\d") & (_c("c9") == ""), _upper("c8")).otherwise("")
    has = F.col("ret").isNotNull()
    return platform(
        best, LASTN=_upper("c2"), FIRSTN=_upper("c3"), MIDDLEN=_upper("c4"), SUFFIXN=_upper("c5"), CNTYIDNUM=F.col("id"), AVADDR1=_upper("c6"), AVADDR2=F.trim(F.concat_ws(" ", _upper("c7"), F.when(country == "", _upper("c8")))), CITY=_upper("c10"),
        STATE=F.substring(_upper("c11"), 1, 2), ZIPCODE=F.substring(_c("c12"), 1, 5), COUNTRY=country, AVSENTDATE=mdy(F.col("sent")), AVRECVDATE=mdy(F.col("ret")), AVRECVMETH=F.when(has, F.when(app == "IN OFFICE", "CAST IN PERSON").otherwise("MAILED")).otherwise("NOT RECEIVED"),
        AVAPPTYPE=app, PRECNAME=_upper("c13"), AVAPPDATE=mdy(F.col("app")), AVBALSTAT=F.when(has, "VALID"), SOURCE=F.col("file"),
    )


def returned_then_mailed(rows: DataFrame) -> DataFrame:
    """Rows of a list of returns and of daily lists of mailings: of a voter the first row that is returned, else the latest issue (the first of equals)."""
    r = rows.withColumn("id", _whole("voter_id")).filter("id is not null").withColumn("ret", mdy(F.col("Date_Returned"))).withColumn("issued", mdy(F.col("date_entered")))
    has = F.col("ret") != ""
    best = best_row(r, ["id"], [has, F.when(has, F.lit("")).otherwise(iso_date(F.col("issued"))), -F.col("seq")])
    c, s = _upper("Category"), _upper("Source")
    email = s == "EMAIL"
    app = (
        F.when(c == "TSX", "IN OFFICE").when((c == "NF") & (s == "HAND"), "HAND CARRY").when(c == "NF", "MAIL").when(c == "NH", "NURSING HOME").when(c.isin("FPO", "CO", "FPM", "AF") & email, "UOCAVA EMAIL")
        .when(c.isin("FPO", "CO"), "CIVILIAN OVERSEAS").when(c.isin("FPM", "AF"), "MILITARY").otherwise(F.concat_ws("|", _c("Category"), _c("Source")))
    )
    way = F.when(app == "IN OFFICE", "CAST IN PERSON").when(s == "HAND", "O T C/ PERSONAL DELIVERY").otherwise("MAILED")
    return platform(
        best, LASTN=_upper("name_last"), FIRSTN=_upper("name_first"), PARTYAFFIL=_party("Party"), CNTYIDNUM=F.col("id"), AVADDR1=_upper("Mail_Street"), CITY=_upper("Mail_City"), STATE=F.substring(_upper("Mail_State"), 1, 2), ZIPCODE=F.substring(_c("Mail_Zip"), 1, 5),
        COUNTRY=_foreign("Mail_Country"), AVSENTDATE=F.col("issued"), AVRECVDATE=F.col("ret"), AVRECVMETH=F.when(has, way).otherwise("NOT RECEIVED"), AVAPPTYPE=app, PRECNAME=_c("Consolidation_Name"), AVAPPDATE=F.col("issued"),
        AVBALSTAT=F.when(has, F.coalesce(F.nullif(_c("Challenged"), F.lit("")), F.lit("VALID"))), SOURCE=F.concat_ws("|", _c("Category"), _c("Source")),
    )


def same_day_in_person(rows: DataFrame) -> DataFrame:
    """A list without a method: who returned the ballot on the day it was asked for voted in person, everyone else by mail. A row a request."""
    asked, back = _c("REQUEST APPLICATION DATE"), _c("RETURN BALLOT DATE")
    office = (back != "") & (back == asked)
    kind = F.when(office, "IN OFFICE").otherwise("MAIL")
    place = F.regexp_extract(_c("CITYSTATE"), r"^(.*?)\s+([A-Z]{2})$", 1)
    given = F.split(_c("FIRSTNAME"), " ", 2)
    return platform(
        rows, LASTN=_c("LASTNAME"), FIRSTN=given[0], MIDDLEN=F.try_element_at(given, F.lit(2)), SUFFIXN=_c("SUFFIXNAME"), PARTYAFFIL=_party("VOTERPARTY"), CNTYIDNUM=_whole("VOTERID"), AVADDR1=_c("ADDRESS1"), AVADDR2=F.trim(F.concat_ws(" ", _c("ADDRESS2"), _c("ADDRESS3"))),
        CITY=F.coalesce(F.nullif(place, F.lit("")), _c("CITYSTATE")), STATE=F.regexp_extract(_c("CITYSTATE"), r"^(.*?)\s+([A-Z]{2})$", 2), ZIPCODE=F.substring(_c("ZIP"), 1, 5), AVSENTDATE=mdy(asked), AVRECVDATE=mdy(back),
        AVRECVMETH=F.when(back == "", "NOT RECEIVED").otherwise(kind), AVAPPTYPE=kind, PRECNAME=_c("PRECINCTNAME"), AVAPPDATE=mdy(asked), AVBALSTAT=F.when(back != "", "VALID"), SOURCE=F.when(office, "in-person").otherwise("mail"),
    )


def reissued_list(rows: DataFrame, categories: dict[str, str]) -> DataFrame:
    """A list that repeats reissued ballots: of a voter the returned row, else the later issue (the first of equals). A challenge flags a returned ballot. The ballot went to the mailing address, or home."""
    r = rows.withColumn("id", _whole("VOTER ID")).filter("id is not null").withColumn("ret", mdy(F.col("DATERETURNED"))).withColumn("issued", mdy(F.col("DATEISSUED")))
    has = F.col("ret") != ""
    best = best_row(r, ["id"], [has, iso_date(F.col("issued")), -F.col("seq")])
    app = coded(F.col("CATEGORY"), categories)
    home, mailed = city_state_zip(F.col("ADDRESS2")), _c("MAILSTREET") != ""
    return platform(
        best, **_named(F.col("`VOTER NAME`")), PARTYAFFIL=_party("PARTY"), CNTYIDNUM=F.col("id"), AVADDR1=F.when(mailed, _upper("MAILSTREET")).otherwise(_upper("ADDRESS1")), AVADDR2=F.when(_c("CAREOF") != "", F.concat(F.lit("C/O "), _upper("CAREOF"))),
        CITY=F.when(mailed, _upper("MAILCITY")).otherwise(home["city"]), STATE=F.when(mailed, F.substring(_upper("MAILSTATE"), 1, 2)).otherwise(home["state"]), ZIPCODE=F.when(mailed, F.substring(_c("MAILZIP"), 1, 5)).otherwise(home["zip"]), COUNTRY=_foreign("MAILCOUNTRY"),
        AVSENTDATE=F.col("issued"), AVRECVDATE=F.col("ret"), AVRECVMETH=F.when(has, F.when(app == "IN OFFICE", "CAST IN PERSON").otherwise("MAILED")).otherwise("NOT RECEIVED"), AVAPPTYPE=app, PRECNAME=_c("PRECINCT"), AVAPPDATE=F.col("issued"),
        AVBALSTAT=F.when(has, F.coalesce(F.nullif(_upper("CHALLENGED"), F.lit("")), F.lit("VALID"))), SOURCE=_upper("CATEGORY"),
    )


def validity_coded(rows: DataFrame, problems: dict[str, str] = CHALLENGES) -> DataFrame:
    """Mail ballots with a validity code BASE-SUFFIX: the base says what is wrong, the suffix how the ballot came back. Of a voter the returned row, else the later mailing (the first of equals)."""
    r = rows.withColumn("id", _whole("VOTERID")).filter("id is not null")
    best = best_row(r, ["id"], [_c("DATERETURNED") != "", _c("DATEMAILED"), -F.col("seq")])
    code = F.split(_upper("VALIDITYCODE"), "-")
    base, suffix = code[0], F.coalesce(F.try_element_at(code, F.lit(2)), F.lit(""))
    has, sent_to = _c("DATERETURNED") != "", _c("BALLOTMAILEDADDR1") != ""
    way = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in RETURN_METHODS.items() for x in p]), suffix), F.lit("MAILED"))
    to = lambda a, b: F.when(sent_to, _upper(a)).otherwise(_upper(b))
    return platform(
        best, LASTN=_upper("LASTNAME"), FIRSTN=_upper("FIRSTNAME"), PARTYAFFIL=F.when(_upper("PARTYDESC").isin(*PARTY_WORDS), _party("PARTYDESC")), CNTYIDNUM=F.col("id"), AVADDR1=to("BALLOTMAILEDADDR1", "RESADDR1"), CITY=to("BALLOTMAILEDCITY", "RESCITYDESC"), STATE=F.substring(to("BALLOTMAILEDSTATE", "RESSTATE"), 1, 2),
        ZIPCODE=F.substring(to("BALLOTMAILEDZIP5", "RESZIP5"), 1, 5), AVSENTDATE=mdy(F.col("DATEMAILED")), AVRECVDATE=mdy(F.col("DATERETURNED")), AVRECVMETH=F.when(has, way).otherwise("NOT RECEIVED"), AVAPPTYPE=F.lit("MAIL"), PRECNAME=_upper("PRECINCTLABEL"),
        AVAPPDATE=mdy(F.col("DATEREQUESTED")), AVBALSTAT=F.when(has, F.when(base.isin("VAL", ""), "VALID").otherwise(coded(base, problems))), SOURCE=_upper("ABSENTEEREQUESTSTATUS"),
    )


def positional_ballots(rows: DataFrame) -> DataFrame:
    """id, name, care_of, mail_to, csz, precinct, party, category, issued, returned of a headerless list (cells, an array of text, and seq).

    On a row in care of someone the name stands one cell earlier. Reissues become one row: the later issue, the later row of equals, with a return on either.
    """
    cell = lambda k: clean(F.try_element_at("cells", F.lit(k + 1)))
    careful = cell(9) != ""
    # only what the choice is made by is read from every row
    r = rows.filter(cell(19).rlike(r"^\d+$")).select(cell(19).try_cast("long").alias("id"), cell(17).alias("issued"), cell(18).alias("returned"), "seq", F.slice("cells", 10, 8).alias("cells"))
    r = with_iso_dates(r, ("issued", "returned"))
    back = F.when(F.col("returned") != "", F.col("returned"))
    best = r.groupBy("id").agg(F.max_by(F.struct("issued", "cells"), F.struct("issued", "seq")).alias("b"), F.max_by(back, F.when(back.isNotNull(), F.col("seq"))).alias("returned"))
    cell = lambda k: clean(F.try_element_at("b.cells", F.lit(k - 8)))
    careful = cell(9) != ""
    return best.select(
        "id", F.when(careful, cell(9)).otherwise(cell(10)).alias("name"), F.when(careful, cell(10)).otherwise("").alias("care_of"), cell(11).alias("mail_to"), cell(12).alias("csz"), cell(14).alias("precinct"),
        F.coalesce(F.nullif(cell(15), F.lit("")), F.lit("--")).alias("party"), F.upper(cell(16)).alias("category"), F.col("b.issued").alias("issued"), F.coalesce("returned", F.lit("")).alias("returned"),
    )


def platform_ballots(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """id, name, last_name, first_name, mail_to, csz, precinct, party, category, issued, returned, issue of the interchange layout; of a voter's rows the last counts.

    A ballot is back if it has a date and came in a way that counts and was not refused; a status but VALID is then its issue.
    """
    words = lambda *cs: F.array_join(F.filter(F.array(*map(_c, cs)), lambda x: x != ""), " ")
    date, status = iso_date(_c("AVRECVDATE")), _upper("AVBALSTAT")
    back = (date != "") & ~_upper("AVRECVMETH").isin("NOT RECEIVED", "UNDELIVERABLE", "REFUSED", "") & (status != "REFUSED TO VOTE")
    zip_code = F.substring(_c("ZIPCODE"), 1, 5)
    csz = F.when((_c("CITY") == "") & (_c("STATE") == "") & (zip_code == ""), "").otherwise(clean(F.concat(_c("CITY"), F.lit(", "), _upper("STATE"), F.lit(" "), zip_code)))
    party = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PARTIES.items() for x in p]), _upper("PARTYAFFIL")), F.lit("--"))
    r = rows.filter(_c("CNTYIDNUM").rlike(r"^\d+$")).select(
        _c("CNTYIDNUM").try_cast("long").alias("id"), words("FIRSTN", "MIDDLEN", "LASTN", "SUFFIXN").alias("name"), _c("LASTN").alias("last_name"), words("SUFFIXN", "FIRSTN", "MIDDLEN").alias("first_name"),
        F.concat(_c("AVADDR1"), F.when(_c("AVADDR2") != "", F.concat(F.lit(" # "), _c("AVADDR2"))).otherwise("")).alias("mail_to"), csz.alias("csz"), _c("PRECNAME").alias("precinct"), party.alias("party"), coded(F.col("AVAPPTYPE"), APP_TYPES).alias("category"),
        iso_date(_c("AVSENTDATE")).alias("issued"), F.when(back, date).otherwise("").alias("returned"), F.when(back & ~status.isin("VALID", ""), status).otherwise("").alias("issue"), F.col(seq).alias("seq"),
    )
    return best_row(r, ["id"], [F.col("seq")]).drop("seq")


def _header(cells: DataFrame, label: str) -> DataFrame:
    """One row: seq and labels of the first row of a sheet that has the label in a cell, as h, which is null if none has. Only rows that hold the label's words are tidied."""
    tidy = F.transform("cells", lambda c: F.lower(clean(c)))
    text = F.lower(F.array_join("cells", "\n"))
    likely = all_of([F.contains(text, F.lit(w)) for w in label.lower().split()])
    return cells.filter(likely).filter(F.array_contains(tidy, label.lower())).agg(F.min_by(F.struct("seq", tidy.alias("labels")), "seq").alias("h"))


def sheet_rows(cells: DataFrame, label: str) -> DataFrame:
    """Rows of a sheet (seq, cells) behind the first that has the label in a cell, as a map from that row's labels to cells; no header, no rows."""
    behind = cells.crossJoin(F.broadcast(_header(cells, label))).filter(F.col("h").isNotNull() & (F.col("seq") > F.col("h.seq")))
    # of repeated labels the first counts
    named = F.filter(F.arrays_zip(F.col("h.labels").alias("k"), F.col("cells").alias("v"), F.sequence(F.lit(1), F.size("h.labels")).alias("i")), lambda e: F.array_position("h.labels", e["k"]) == e["i"])
    return behind.select("seq", F.map_from_entries(F.transform(named, lambda e: F.struct(e["k"], clean(e["v"])))).alias("row"))


def sheet_columns(cells: DataFrame, label: str, names: dict[str, str]) -> DataFrame:
    """sheet_rows() with the cells of the labels in `names` as columns of the names given there, empty where there is none; a label's place is looked up once, in the header."""
    places = _header(cells, label).filter("h is not null").select(F.col("h.seq").alias("__head"), *[(F.array_position("h.labels", k) - 1).cast("int").alias(f"__{c}") for k, c in names.items()])
    behind = cells.crossJoin(F.broadcast(places)).filter("seq > __head")
    return behind.select("seq", *[clean(F.get("cells", F.col(f"__{c}"))).alias(c) for c in names.values()])


def sheet_ballots(cells: DataFrame, roll: DataFrame) -> DataFrame:
    """voter_id, how, precinct, category, issued, returned of a tracking sheet whose header stands anywhere, matched to the roll (id, last, first, house, zip, precinct) by name.

    A precinct's code that the roll's voters do not tell is named as most of the matched ballots of that code. What is matched is written once, and so are the codes' names.
    """
    named = {"category/org": "cat", "issued": "issued", "av id": "av", "returned": "returned", "name": "name", "mailed to": "street", "city": "city", "precinct": "code"}
    rows = sheet_columns(cells, "Category/Org", named).filter(F.col("av").rlike(r"^\d+$") & F.col("av").try_cast("long").isNotNull())
    letters = lambda c: F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))
    parts = F.split("name", ",", 2)
    c = F.upper("cat")
    category = F.when(c == "NH", "N").when(c == "OS-CI", "CO").when(c == "OS-MI", "MO").when(c == "MIL", "M").when(c == "EVOFF", "EV").otherwise("A")
    asked = rows.select(
        F.col("av").try_cast("long").alias("seq"), letters(parts[0]).alias("last"), F.split(letters(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))), " ")[0].alias("first"), F.regexp_extract(letters(F.col("street")), r"^(\d+)\b", 1).alias("house"), city_state_zip(F.col("city"))["zip"].alias("zip"),
        F.col("seq").alias("at"), "code", category.alias("category"), "issued", "returned",
    )
    met = stashed(match_persons(with_iso_dates(asked, ("issued", "returned"), ANY_DAY), roll, ("at", "code", "category", "issued", "returned"), ("precinct",)), "matched")
    common = stashed(majority(met.filter("precinct is not null"), "code", "precinct", "at").select("code", F.col("precinct").alias("usual")), "usual")
    return met.join(common, "code", "left").select("voter_id", "how", F.coalesce("precinct", "usual", "code").alias("precinct"), "category", "issued", "returned")


def spreadsheet_roll(cells: DataFrame) -> DataFrame:
    """id, last, first, precinct, street, city, zip, registered, party of a report-like sheet (cells in that order: id, name, precinct, street, csz, registered, party): only rows that begin with a number and have a name; the last of an id counts."""
    from civlake.functions.columns import any_date

    cell = lambda k: clean(F.try_element_at("cells", F.lit(k)))
    name, csz = F.split(cell(2), ",", 2), cell(5)
    place = r"^(.*?),\s*([A-Z]{2})\s+(\d{5})"
    r = cells.filter(cell(1).rlike(r"^\d+$") & (cell(2) != "")).select(
        cell(1).try_cast("long").alias("id"), F.trim(name[0]).alias("last"), F.trim(F.coalesce(F.try_element_at(name, F.lit(2)), F.lit(""))).alias("first"), cell(3).alias("precinct"), cell(4).alias("street"), F.when(csz.rlike(place), F.regexp_extract(csz, place, 1)).otherwise(csz).alias("city"),
        F.regexp_extract(csz, place, 3).alias("zip"), any_date(cell(6)).alias("registered"), F.coalesce(F.nullif(cell(7), F.lit("")), F.lit("--")).alias("party"), "seq",
    )
    return best_row(r, ["id"], [F.col("seq")]).drop("seq")
