"""Who wrote a ticket, and whether a person did: identity steps in order, and the filter of automated mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The steps of identity resolution in order, and the directory's key that each looks up.
STEPS = (("external", "customer"), ("meta", "customer"), ("integration", "customer"), ("system", "system"), ("phone", "phone"), ("email", "email"))


def e164(phone: Column) -> Column:
    """A phone number as + and digits: ten digits get +1, others keep what they have; null where there is no digit."""
    d = F.regexp_replace(phone, "[^0-9+]", "")
    bare = F.when(d.startswith("+"), d).when(F.length(d) == 10, F.concat(F.lit("+1"), d)).otherwise(F.concat(F.lit("+"), d))
    return F.when(d.rlike("[0-9]"), bare)


def address(email: Column) -> Column:
    """An address in lower case without blanks around it; null where it is empty."""
    return F.nullif(F.lower(F.trim(email)), F.lit(""))


def directory_keys(customers: DataFrame) -> DataFrame:
    """(kind, key, customer_id) of the keys that name one customer only; needs customer_id, system_id, phone, email."""
    own = F.col("customer_id").cast("string")
    keys = {"customer": own, "system": F.col("system_id").cast("string"), "phone": e164(F.col("phone")), "email": address(F.col("email"))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys.items()]))
    found = customers.select("customer_id", each.alias("k")).select("customer_id", "k.*").where("key IS NOT NULL AND key <> ''")
    return found.groupBy("kind", "key").agg(F.min("customer_id").alias("customer_id"), (F.min("customer_id") != F.max("customer_id")).alias("unsure")).where("NOT unsure").drop("unsure")


def resolve(contacts: DataFrame, customers: DataFrame) -> DataFrame:
    """contact_id, customer_id and step: the first step whose key finds one customer of the directory (JOIN-14).

    ``contacts``: contact_id, external_id, meta_id, integration_id, system_id, phone, email, any of which may be missing.
    A step whose key is unknown, or names several customers, leaves the contact to the next; a contact that no step
    finds comes back with null. All steps are one join: each contact sends the keys that it has, so missing ones never
    meet, and the answers are combined by contact.
    """
    keys = {"external": F.col("external_id").cast("string"), "meta": F.col("meta_id").cast("string"), "integration": F.col("integration_id").cast("string"), "system": F.col("system_id").cast("string"), "phone": e164(F.col("phone")), "email": address(F.col("email"))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(step).alias("step"), F.lit(kind).alias("kind"), keys[step].alias("key")) for k, (step, kind) in enumerate(STEPS)]))
    asked = contacts.select("contact_id", each.alias("k")).select("contact_id", "k.*").where("key IS NOT NULL AND key <> ''")
    hits = asked.join(directory_keys(customers), ["kind", "key"]).groupBy("contact_id").agg(F.min(F.struct("place", "step", "customer_id")).alias("hit"))
    return contacts.select("contact_id").distinct().join(hits, "contact_id", "left").select("contact_id", F.col("hit.customer_id").alias("customer_id"), F.col("hit.step").alias("step"))


# Fixed values of the filter of automated messages.
SKIP_TAGS, FORCE_TAGS = ("ai_ignore", "no-ai", "human-only"), ("ai_force", "force-ai")
CLOSED = ("closed", "spam", "deleted")
PLATFORMS = ("klaviyo.com", "mailchimp.com", "sendgrid.net", "constantcontact.com", "activecampaign.com")
NOTICES = ("new sms to", "sms notification", "text message notification")
CALLS, LEAST_CONTENT = "ringcentral.com", 50


def automated(tags: Column, status: Column, subject: Column, email: Column, name: Column, via: Column, channel: Column, phone: Column, longest: Column, messages: Column, from_agent: Column) -> Column:
    """A struct of automated and rule, the first rule that decides (FLT-9); missing texts are empty.

    ``longest``: characters of the longest message without blanks around it; ``from_agent``: whether an agent wrote one.
    Tags decide first, then the status; mail of the call service is a person's if it has content or a phone number;
    then come no-reply addresses, marketing platforms, text message notices, names of teams, and pure interfaces.
    Text messages are spared the rules on platforms and names.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    names = F.transform(F.coalesce(tags, F.array().cast("array<string>")), low)
    tagged = lambda known: F.arrays_overlap(names, F.array(*[F.lit(x) for x in known]))
    holds = lambda c, parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(c, p))
    subject, email, name, via, channel = low(subject), low(email), low(name), low(via), low(channel)
    sms = (channel == "sms") | (via == "sms") | F.contains(subject, F.lit("sms"))
    team = name.endswith(" team") | (name.startswith("the ") & F.contains(name, F.lit("team")))
    calls = F.contains(email, F.lit(CALLS))
    person = (F.coalesce(longest, F.lit(0)) > LEAST_CONTENT) | (F.coalesce(phone, F.lit("")) != "")
    rules = (
        (tagged(SKIP_TAGS), True, "tag_skip"), (tagged(FORCE_TAGS), False, "tag_force"), (low(status).isin(*CLOSED), True, "status"), (calls & ~person, True, "empty_call"), (calls, False, "call"),
        (holds(email, ("no-reply", "noreply")), True, "no_reply"), (~sms & holds(email, PLATFORMS), True, "platform"), (holds(subject, NOTICES), True, "notice"), (~sms & team, True, "team"),
        ((via == "api") & (F.coalesce(messages, F.lit(0)) > 0) & ~F.coalesce(from_agent, F.lit(False)), True, "interface"),
    )
    out = F.struct(F.lit(False).alias("automated"), F.lit("person").alias("rule"))
    for hit, value, rule in reversed(rules):
        out = F.when(hit, F.struct(F.lit(value).alias("automated"), F.lit(rule).alias("rule"))).otherwise(out)
    return out
