"""Landed provider JSON to neutral rows. Numbers are read as text, so no amount is ever a floating-point value."""

from __future__ import annotations

from email.utils import parsedate_to_datetime
from urllib.parse import parse_qs, quote, urlencode, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import local_date_column
from ..functions.policy import sync_status

ACCOUNT = "id string, itemId string, type string, subtype string, number string, name string, balance string, currencyCode string, creditData struct<balanceCloseDate:string,balanceDueDate:string,availableCreditLimit:string,creditLimit:string,status:string>, updatedAt string"
TRANSACTION = "id string, accountId string, status string, type string, amount string, amountInAccountCurrency string, currencyCode string, date string, description string, descriptionRaw string, providerCode string, providerId string, operationType string, categoryId string, category string, merchant struct<name:string,businessName:string>, creditCardMetadata struct<installmentNumber:string,totalInstallments:string,totalAmount:string,purchaseDate:string,payeeMCC:string,cardNumber:string,billId:string,billForecastDate:string,feeType:string>"
BILL = "id string, dueDate string, billClosingDate string, totalAmount string, totalAmountCurrencyCode string, minimumPaymentAmount string, allowsInstallments boolean, payments array<struct<id:string,valueType:string,paymentDate:string,paymentMode:string,amount:string,currencyCode:string>>, financeCharges array<struct<id:string,type:string,amount:string,currencyCode:string,additionalInfo:string>>"
ITEM = "id string, connector struct<id:string,name:string>, status string, executionStatus string, lastUpdatedAt string, updatedAt string, consentExpiresAt string, error struct<code:string>"
EVENTS = ("item/created", "item/updated", "item/deleted", "item/error", "item/waiting_user_input", "item/waiting_user_action", "item/login_succeeded", "transactions/created", "transactions/updated", "transactions/deleted")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; primitives stay text."""
    return spark.read.schema(schema).option("primitivesAsString", "true").json(path)


def pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pages of {results, next}: one row for each result."""
    return read(spark, path, f"results array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in split_fields(schema))}>>, next string").select(F.inline("results"))


def split_fields(schema: str) -> list[str]:
    out, depth, last = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:k])
            last = k + 1
    return [*out, schema[last:]]


def amount(text: Column) -> Column:
    """Exact decimal of a JSON number, exponents included; null for what is none."""
    return text.try_cast("decimal(38,12)").try_cast("decimal(20,6)")


def last_digits(text: Column, n: int = 4) -> Column:
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(digits) >= n, F.substring(digits, -n, n))


def accounts(raw: DataFrame) -> DataFrame:
    kind = F.when((F.col("type") == "CREDIT") | (F.col("subtype") == "CREDIT_CARD"), "CREDIT_CARD").when(F.col("subtype") == "CHECKING_ACCOUNT", "CHECKING").when(F.col("subtype") == "SAVINGS_ACCOUNT", "SAVINGS").when(F.col("type") == "INVESTMENT", "INVESTMENT").otherwise("OTHER")
    return raw.select(
        F.col("id").alias("account_id"), F.col("itemId").alias("connection_id"), kind.alias("account_type"), "name", last_digits(F.col("number")).alias("last_four"), amount(F.col("balance")).alias("current_balance"), F.col("currencyCode").alias("currency"),
        amount(F.col("creditData.creditLimit")).alias("credit_limit"), amount(F.col("creditData.availableCreditLimit")).alias("available_credit_limit"), F.dayofmonth(F.col("creditData.balanceCloseDate").try_cast("date")).alias("closing_day"), F.dayofmonth(F.col("creditData.balanceDueDate").try_cast("date")).alias("due_day"),
    )


def transactions(raw: DataFrame, zone: str = "America/Sao_Paulo") -> DataFrame:
    card = F.col("creditCardMetadata")
    return raw.select(
        F.col("id").alias("provider_transaction_id"), F.col("accountId").alias("account_id"), F.coalesce("status", F.lit("UNKNOWN")).alias("status"), F.col("type").alias("provider_type"), amount(F.col("amount")).alias("provider_amount"), F.col("currencyCode").alias("provider_currency"),
        amount(F.col("amountInAccountCurrency")).alias("account_amount"), local_date_column(F.col("date").try_cast("timestamp"), zone).alias("local_date"), F.coalesce("descriptionRaw", "description").alias("description"), F.col("categoryId").alias("provider_category_id"),
        F.coalesce(F.col("merchant.name"), F.col("merchant.businessName")).alias("merchant_name"), card["installmentNumber"].try_cast("int").alias("instalment_number"), card["totalInstallments"].try_cast("int").alias("instalment_total"), amount(card["totalAmount"]).alias("purchase_total"),
        card["purchaseDate"].try_cast("date").alias("purchase_date"), card["payeeMCC"].alias("payee_mcc"), last_digits(card["cardNumber"]).alias("card_last_four"), card["billId"].alias("provider_bill_id"), F.col("operationType").alias("operation_type"),
    )


def bills(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("bill_id"), F.col("dueDate").try_cast("date").alias("due_date"), F.col("billClosingDate").try_cast("date").alias("close_date"), amount(F.col("totalAmount")).alias("total_amount"), F.col("totalAmountCurrencyCode").alias("currency"), amount(F.col("minimumPaymentAmount")).alias("minimum_payment"))


def bill_payments(raw: DataFrame) -> DataFrame:
    x = raw.select(F.col("id").alias("bill_id"), F.explode("payments").alias("p"))
    return x.select("bill_id", F.col("p.id").alias("payment_id"), F.col("p.paymentDate").try_cast("date").alias("payment_date"), amount(F.col("p.amount")).alias("amount"), F.col("p.currencyCode").alias("currency"))


def bill_charges(raw: DataFrame) -> DataFrame:
    x = raw.select(F.col("id").alias("bill_id"), F.explode("financeCharges").alias("c"))
    return x.select("bill_id", F.col("c.id").alias("charge_id"), F.col("c.type").alias("charge_type"), amount(F.col("c.amount")).alias("amount"), F.col("c.currencyCode").alias("currency"))


def connections(raw: DataFrame, event: Column | None = None) -> DataFrame:
    return raw.select(F.col("id").alias("connection_id"), F.col("connector.name").alias("institution_name"), sync_status(F.lit(None).cast("string") if event is None else event, F.col("status"), F.col("executionStatus"), F.col("error.code")).alias("local_status"), F.col("lastUpdatedAt").try_cast("timestamp").alias("last_successful_sync_at"))


#: Most ids of an event (fixed values), and of a request.
MOST_IDS = {"transactions/updated": 400, "transactions/deleted": 1000}
REQUEST_IDS, MOST_COUNT = 500, 1000
CURSOR_KEYS = ("accountId", "after", "createdAtFrom", "dateFrom", "dateTo", "ids")
HOOK = "event string, eventId string, itemId string, accountId string, transactionIds array<string>, transactionsCount string, createdTransactionsLink string, createdTransactionsLinkV2 string, transactionsCreatedAtFrom string, error struct<code:string>"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def webhooks(raw: DataFrame, payload: str = "payload", identifier: str = UUID) -> DataFrame:
    """Rows with their parsed event (hook) and is_valid: a known event with all that its kind needs, ids within their bounds."""

    def is_id(c: Column) -> Column:
        return F.coalesce(c.rlike(identifier), F.lit(False))

    out = raw.withColumn("hook", F.from_json(payload, HOOK, {"primitivesAsString": "true"}))
    h = F.col("hook")
    count = h["transactionsCount"].try_cast("int")
    ids = F.coalesce(h["transactionIds"], F.array().cast("array<string>"))
    of_data = is_id(h["accountId"]) & F.coalesce(count.between(0, MOST_COUNT), F.lit(False))
    created = of_data & (h["createdTransactionsLink"].isNotNull() | h["createdTransactionsLinkV2"].isNotNull()) & h["transactionsCreatedAtFrom"].try_cast("timestamp").isNotNull()
    named = F.lit(False)
    for event, most in MOST_IDS.items():
        named = named | ((h["event"] == event) & F.size(ids).between(1, most))
    named = named & of_data & F.coalesce(F.size(ids) == count, F.lit(False)) & F.forall(ids, is_id)
    kind = F.when(h["event"] == "transactions/created", created).when(F.startswith(h["event"], F.lit("transactions/")), named)
    kind = kind.when(h["event"] == "item/error", F.length(h["error"]["code"]).between(1, 200)).otherwise(F.lit(True))
    common = h["event"].isin(*EVENTS) & is_id(h["eventId"]) & is_id(h["itemId"])
    return out.withColumn("is_valid", F.coalesce(common & kind, F.lit(False)))


class Landed:
    """A provider's landed files as one source: a folder of JSON lines for each kind, pages as they were answered."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def connections(self) -> DataFrame:
        return connections(read(self.spark, f"{self.folder}/items", ITEM))

    def connection(self, external_id: str) -> DataFrame:
        return self.connections().where(F.col("connection_id") == external_id)

    def accounts(self, connection: str | None = None) -> DataFrame:
        rows = accounts(read(self.spark, f"{self.folder}/accounts", ACCOUNT))
        return rows if connection is None else rows.where(F.col("connection_id") == connection)

    def transactions(self, account: str | None = None, zone: str = "America/Sao_Paulo") -> DataFrame:
        rows = transactions(pages(self.spark, f"{self.folder}/transactions", TRANSACTION), zone)
        return rows if account is None else rows.where(F.col("account_id") == account)

    def bills(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        raw = read(self.spark, f"{self.folder}/bills", BILL)
        return bills(raw), bill_payments(raw), bill_charges(raw)


def page_query(account: str, cursor: str | None = None) -> dict[str, str]:
    """The parameters of a page's request; a cursor must be a query of the same account with known parameters only."""
    if cursor is None:
        return {"accountId": account}
    found = parse_qs(cursor.removeprefix("?"), keep_blank_values=True)
    if not cursor.startswith("?") or found.get("accountId") != [account]:
        raise ValueError("the cursor belongs to another account")
    if set(found) - set(CURSOR_KEYS):
        raise ValueError("the cursor holds an unknown filter")
    return {k: v[-1] for k, v in found.items()}


def ids_cursor(account: str, ids: list[str]) -> str:
    """The cursor of an event that names 1 to 500 different transactions."""
    if not 1 <= len(ids) <= REQUEST_IDS or len(set(ids)) < len(ids):
        raise ValueError("an event names 1 to 500 different transactions")
    return "?" + urlencode({"accountId": account, "ids": ",".join(ids)})


def created_cursor(account: str, since: str, link: str, origin: str, is_v2: bool) -> str:
    """The cursor of an event that links to created transactions; the link must be the provider's and say the same as the event."""
    at = urlsplit(link)
    if f"{at.scheme}://{at.netloc}" != origin or at.path not in (("/v2/transactions",) if is_v2 else ("/v2/transactions", "/transactions")):
        raise ValueError("the link leads elsewhere")
    told = parse_qs(at.query)
    if told.get("accountId", [""])[0] != account or told.get("createdAtFrom", [""])[0] != since:
        raise ValueError("the link is not about the event's account and time")
    query = {"accountId": account, "createdAtFrom": since}
    after = told.get("after", [None])[0]
    if at.path == "/v2/transactions" and after is not None and "{" not in after:
        query["after"] = after
    return "?" + urlencode(query)


#: What may be asked again (fixed values), how often, and waits in milliseconds.
SAFE_METHODS, RETRIED_STATUS, MOST_RETRIES, LEAST_WAIT, MOST_WAIT, TIME_OUT = ("GET", "HEAD", "OPTIONS"), (429, 500, 502, 503, 504), 3, 250, 30_000, 15_000


def retry_wait(method: str, status: int, retries: int, retry_after: str | None = None, now: float = 0.0, dice: float = 1.0) -> int | None:
    """Milliseconds until a request is tried again, or None if it is not. Only safe methods are; the server's word counts before doubled waits."""
    if method not in SAFE_METHODS or status not in RETRIED_STATUS or retries >= MOST_RETRIES:
        return None
    if retry_after is not None:
        try:
            wait = float(retry_after)
        except ValueError:
            try:
                wait = max(0.0, parsedate_to_datetime(retry_after).timestamp() - now)
            except ValueError:
                wait = -1.0
        if 0 <= wait < float("inf"):
            return min(MOST_WAIT, round(wait * 1000))
    return round(dice * min(MOST_WAIT, LEAST_WAIT * 2**retries))


def refresh_request(external_id: str) -> dict[str, object]:
    """What asks a provider to refresh a connection; it is no safe method, so it is never sent twice."""
    return {"method": "PATCH", "path": f"/items/{quote(external_id, safe='')}", "body": {}, "retries": 0}
