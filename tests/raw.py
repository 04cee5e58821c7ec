"""A five-report raw distribution with the irregularities of the published files."""

from pathlib import Path

MDR = (
    "﻿MDR_REPORT_KEY|EVENT_KEY|REPORT_NUMBER|MDR_REPORT_KEY_DUP|DATE_RECEIVED|DATE_REPORT|DATE_OF_EVENT|EVENT_TYPE|MANUFACTURER_NAME|"
    "REPORTER_OCCUPATION_CODE|SOURCE_TYPE|SUPPLEMENT_NUMBER|REPORTER_COUNTRY_CODE|ADVERSE_EVENT_FLAG|PRODUCT_PROBLEM_FLAG\r\n"
    "700001|1|M-2001|700001|20190314|20190310|20190301|D|Acme Medical|001|M|0|us|Y|N\r\n"
    "700002|2|M-2002|700002|03/20/2019||20190318|IN|Acme Medical|002|M,V||US|Y|Y\r\n"
    "\r\n"
    "700003|3|RWD-77|700003||20200105|20191220|M|Borealis|0HP|V|0|de|N|Y\r\n"
    "700004|4|M-2001|700004|20200210|20200201|20190101|D| acme medical |100|M|1|ca|Y|N\r\n"
    "700005|5|M-2005|700005|20210305|20210301||IN|Cygnus|XYZ|U||FR|Y\r\n"
)
DEVICE = (
    "MDR_REPORT_KEY|DEVICE_EVENT_KEY|BRAND_NAME|GENERIC_NAME|MODEL_NUMBER|MANUFACTURER_D_NAME|DEVICE_REPORT_PRODUCT_CODE|DEVICE_AGE_TEXT|"
    "IMPLANT_FLAG|DEVICE_OPERATOR|DEVICE_EVALUATED_BY_MANUFACTURER|REPROCESSED_AND_REUSED_FLAG\n"
    "700001|10|SECOND|PUMP|P9|Acme Medical|frn|1 YR|N||Y|N\n"
    "700001|9|FLOWMAX|INFUSION PUMP|P1|Acme Medical|frn |3 YR|Y|NURSE|Y|N\n"
    "700002|11|FLOWMAX|INFUSION PUMP|P1|Acme Medical|FRN|6 MO|N|||\n"
    "700003|12|NORTHLIGHT|LASER|L2|Borealis|GEX|14 DY|N|||\n"
    "700004\t13|FLOWMAX|INFUSION PUMP|P2||FRN||Y|||\n"
)
FOI = (
    "MDR_REPORT_KEY|MDR_TEXT_KEY|TEXT_TYPE_CODE|PATIENT_SEQUENCE_NUMBER|DATE_REPORT|FOI_TEXT\r\n"
    "an orphan line before any record\r\n"
    "700001|1|D|1|20190310|The pump stopped\r\n"
    "   without alarm\r\n"
    "and the patient died.\r\n"
    "700001|2|N|1|20190310|Evaluation: a|b and a \"quote\" (b)(4)\r\n"
    "700003|3|D|1|20200105|Forwarded under 803.22(B)(2) for the record (b)(6)\r\n"
)
PATIENT = (
    "MDR_REPORT_KEY|PATIENT_SEQUENCE_NUMBER|DATE_RECEIVED|SEQUENCE_NUMBER_TREATMENT|SEQUENCE_NUMBER_OUTCOME|PATIENT_AGE|PATIENT_SEX|PATIENT_WEIGHT|PATIENT_ETHNICITY|PATIENT_RACE\n"
    "700001|1|20190314||D,R|67 YR|F|||\n"
    "700002|1|20190320||H|14 WK|M|||\n"
    "700003|1|20200105||O|7 DEC|||| \n"
    "700004|1|20200210||L,H|67|M|||\n"
    "700004|2|20200210||O, R|(b)(6) XX|F|||\n"
    "700005|1|20210305||S|40 YR|F|||\n"
)
PROBLEM5 = "MDR_REPORT_KEY|PATIENT_SEQUENCE_NO|PROBLEM_CODE|DATE_ADDED|DATE_CHANGED\n700001|1|1802|2019/03/14|\n700002|1|2001|2019/03/20|\n700002|1||2019/03/20|\n"
PROBLEM3 = "700001|1|1802\n700002|1|2001\n"
DEVPROBLEM = "700001|1069\n700001|1670\n700002|1069\n700003|2993\n700004|1069\n"
DICTIONARY = '"FDA_CODE","TERM","NCIT_CODE","IMDRF_CODE"\n"1069","Break","C1","A1"\n"1670","Leak, or splash","C2","A2"\n"2993"," Adverse event ","C3","A3"\n"1802","Death","C4","E1"\n'


def write(folder: Path) -> Path:
    for name, content in (
        ("mdrfoiThru2021.txt", MDR), ("device2019.txt", DEVICE), ("foitext2019.txt", FOI), ("patient2019.txt", PATIENT), ("patientproblemcode.txt", PROBLEM5),
        ("patientproblemcode3.txt", PROBLEM3), ("foidevproblem.txt", DEVPROBLEM), ("deviceproblemcodes.csv", DICTIONARY),
    ):
        data = content.encode("utf-8") if content.startswith("﻿") else content.encode("latin-1")
        (folder / name).write_bytes(data)
    return folder
