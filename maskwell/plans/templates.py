"""Texts built from row keys, so that every detector meets matches and near misses.

A template is plain text with fields such as ``{k4}``: the row key modulo 10^4, padded
with zeros to 4 digits. ``{k}`` is the key itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.session import spread
from maskwell.sources.readers import read_table

FIELD = re.compile(r"\{k(\d*)\}")

TYPE_TEMPLATES = {
    "aadhaar": "Aadhaar {k4} {k4} 9073, not {k4}-{k4}-1111, {k4} {k4} 12345 or x{k4} {k4} 1234",
    "pan": "PAN ABCDE{k4}F and abcde{k4}g, not ABCD{k4}F, ABCDEF{k4}G or ABCDE{k5}F",
    "phone": "call +91 98765{k5}, +91-88765{k5}, 70000{k5} or 59999{k5} or 98765{k6}",
    "us_phone": "(212) 555-{k4}, +1 212-555-{k4}, 212 555 {k4}, x+1 212-555-{k4}, 2125 555-{k4}",
    "email": "to anna.b.c{k}@mail{k}.example.com, x..y{k}@z.co, a@b.c, no{k}@host and {k4}%q@a-b.io",
    "ip_address": "from 10.0.{k2}.255 via 256.1.1.{k2} or 1.2.3.4.{k2}, v1.{k2}.3, 192.168.1.{k2}",
    "passport": "passport U{k7}, z{k7}, not U{k6}, UU{k7} or U{k8}",
    "ifsc": "IFSC HDFC0{k6}, sbin0AB{k4}, not HDFC1{k6} or HDFC0{k7}",
    "account_number": "account 1{k8}, 50100{k9}, 91234{k5}, 9123456789{k10}0, {k8} and 12{k18}",
    "upi": "pay ann.{k}@okaxis, b_{k}@PAYTM, c-{k}@ybl, d{k}@okbank or e@upi and f{k}@ibl.com",
    "credit_card": "card 4012-{k4}-7890-1234, 5500 {k4} 1111-2222, 4012{k4}78901234, 4012-{k4}-78",
    "cvv": "cvv {k3}, CVV: {k4}, cvv:{k5}, Cvv{k3} xcvv {k3} cvv::  {k4}.",
    "expiry_date": "valid 0{k1}/{k4}, 12/{k2}, 13/{k2}, 11/{k5}, 10/20{k2} and 1/{k2}",
    "device_id": "on android-9f{k8}, IOS-dead{k4}, ios-dead{k3}, ios-{k9}g and myandroid-{k8}",
    "fingerprint": "print fp_hash_ab{k4}, FP_HASH_{k2}ff, fp_hash_xy{k4}, my_fp_hash_{k4}",
    "face_template": "face face_tmp_00{k4}, FACE_TMP_{k3}e, face_tmp_ g{k4}, xface_tmp_{k4}",
    "dob": "born 1{k1}/12/19{k2}, {k1}-1-20{k2}, 31/13/19{k2}, 3{k1}/01/2001, 12-11-18{k2}",
    "pincode": "pin 38{k4}, PINCODE:4{k5}, zip : 5{k5}, pin 0{k5}, pin 38{k5}, spin 12{k4}",
    "vehicle_number": "GJ 01 AB {k4}, mh12x{k4}, DL-3C-{k4}, in 12 of {k4}, KA 05 ABC {k4}",
    "voter_id": "voter ABC{k7}, xyz{k7}, AB{k7}, ABCD{k7}, ABC{k8}",
    "gstin": "gst 22AAAAA{k4}A1Z5, 07bbbbb{k4}c9z{k1}, 22AAAAA{k4}A0Z5, 22AAAA{k4}A1Z5",
    "swift_code": "swift: HDFCINBB, BIC HDFCIN{k2}XYZ, bic:HDFCIN{k1}, swift movement {k}",
}

CONTEXT_TEMPLATE = (
    "Mr. Rahul Sharma{k2} met Dr Meera Nair Iyer Rao Das, dr. who, MR. Bean and Smt. Asha {k} "
    "at {k3}, Park Lane near gate {k}. Lives at {k2} MG Road, Flat {k3}, Pune\n"
    "Sri Ravi, {k}  Road; 7 Road. Prof.  Anand Kumar\n{k4} old mill towers"
)

MIXED_TEMPLATE = (
    "Card 4012 {k4} 7890 1234 cvv {k3} exp 12/05/2024 and 05/2024, mail ann.b{k}@mail.com, "
    "ann.b{k}@mail.com twice\ncall 98765{k5} or +91 98765{k5} for 212-555-{k4}\n"
    "Mr. Rahul Sharma of 12, Park Lane block {k2}\nPAN ABCDE{k4}F ABCDE{k4}F pin 38{k4}"
)

OVERLAP_TEMPLATE = (
    "4012 {k4} 7890 1234 on 12/05/2024 and 05/2024; a{k}.b@okaxis.com pays ann.{k}@upi; "
    "Dr. Asha Rao 98765{k5} at {k4}, Mill Street 212-555-{k4} and 4821 {k4} 6625 4821 {k4} 6625"
)

THREAT_TEMPLATES = (
    "clean text number {k}",
    "x'; DROP TABLE users{k}; drop  database d; truncate table t; Drop table u",
    "delete from t{k} where 1 = 1; DELETE FROM b WHERE 1=1",
    "insert into a select * from b{k} and insert into c select d",
    "1 union select pass{k} from users union all select 1",
    "exec (x{k}) execute(y) xp_cmdshell z; alter t",
    "a <script src=x>alert({k})</script> b <SCRIPT>y</script> c <script>open",
    "javascript : void({k}) JavaScript:1",
    "<img onload=a{k} onERROR =b onclick=c onfocus=d onsubmit=e>",
    "<iframe src={k}> <iframe> <iframe",
    "document.cookie + window.location = {k}; documentxcookie",
    "rm -rf /tmp/{k}; rmdir /s q; rm  -rf b",
    "wget http://x{k} curl  https://y curl ftp://z",
    "bash -c ls{k}; powershell -c x; cmd  -c y; zsh -c z",
    "__import__ ( 'os' ){k} subprocess.call(a) os.system(b) osxsystem",
    "eval (a{k}) exec(b) evaluate(c)",
    "cat /etc/passwd /etc/shadow /etc/hosts {k}",
    "../../a{k} ../b ../../../../c",
    "%2e%2e%2f{k} %2E%2E%2F",
    "..\\a{k} .\\b",
)


def _digits(width: str) -> tuple[int, int] | None:
    """(modulus, width) of a field; None for the plain key."""
    return (10 ** int(width), int(width)) if width else None


def as_column(template: str, key: Column) -> Column:
    parts, at = [], 0
    for field in FIELD.finditer(template):
        parts.append(F.lit(template[at : field.start()]))
        spec = _digits(field[1])
        if spec is None:
            parts.append(key.cast("string"))
        else:
            number = (key % F.lit(spec[0])).cast("string")
            parts.append(F.lpad(number, spec[1], "0"))
        at = field.end()
    return F.concat(*parts, F.lit(template[at:]))


def one_of(templates: tuple[str, ...], key: Column) -> Column:
    choice = F.array(*[as_column(t, key) for t in templates])
    return F.element_at(choice, (key % len(templates) + 1).cast("int"))


def templated(spark: SparkSession, sf: str, *templates: str) -> DataFrame:
    """One text per customer: (doc_id, text)."""
    key = F.col("doc_id")
    rows = read_table(spark, sf, "customer", "c_custkey").select(
        F.col("c_custkey").alias("doc_id")
    )
    return spread(rows, "doc_id").withColumn("text", one_of(templates, key))
