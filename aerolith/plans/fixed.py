"""Fixed values of the SQL side, written out there so that it doesn't rest on the values under test."""

NOT_AIRPORTS = """'WHEN', 'WITH', 'WILL', 'WERE', 'WHAT', 'PUSH', 'PULL', 'ONLY', 'OVER', 'COPY', 'CALL', 'CLMB', 'CONT', 'EACH', 'ELSE', 'LEFT', 'LIVE', 'LOST', 'YOUR', 'YEAR', 'ZERO', 'ZONE', 'READ', 'RQST', 'RPLY', 'VOID', 'VERY', 'VFRQ', 'OPER', 'SEND', 'STOP', 'STAY', 'UPDT', 'UPON', 'TIME', 'TEST', 'THEN', 'TILL', 'TAKE', 'ATIS', 'ACFT', 'AFTN', 'MAIN', 'MNTN', 'NEXT', 'NONE', 'HOLD', 'HIGH', 'FROM', 'FREQ', 'BACK', 'BASE', 'DOWN', 'DCPC', 'AREA', 'ACAS', 'APCH', 'SKED', 'SUPP', 'WIND', 'WIDE', 'TAXI', 'TURN', 'TRSN', 'PLAN', 'PROC', 'PDCL', 'PDOP', 'PFRQ', 'CLRD', 'CKPT', 'CPDL', 'TCAS', 'SELC', 'DATE', 'DATA', 'DPTS', 'DEST', 'STAR', 'CODE', 'GATE', 'RSTR', 'FILE', 'FULL', 'NOSE', 'PAGE', 'ASAT', 'ALSO', 'MINS', 'MUST', 'SIXI', 'ECFG', 'HELD', 'CAPT', 'TAIL', 'EGGX', 'CZQX', 'BIRD', 'KZNY', 'KZAK', 'PAZA', 'RJJJ', 'VHHK', 'WAAF', 'YBBB'"""
REGIONS = "A[GNY]|B[GIK]|C[YZ]|D[ABFGINRTX]|E[BDEFGHIKLNPSTVY]|F[ABCDEGHIJKLMNOPQSTVWXYZ]|G[ABCEFGLMOQSUV]|H[ABCDEHKLRSTU]|L[ABCDEFGHIJKLMNOPQRSTUVWXYZ]|M[BDGHKMNPRSTUWYZ]|N[CFGILSTVWZ]|O[ABEIJKLMOPRSTY]|P[ABCFGHJKLMOPTW]|R[CJKOP]|S[ABCDEFGKLMNOPSUVWY]|T[ABCDFGIJKLNQRTUVX]|U[ABCDEGHIKLMNORSTUW]|V[ACDEGHILMNOQRTVY]|W[ABIMPRS]|Y[ABCDFGHILMNOPRSTUVWY]|Z[ABGHJKLMPSUWY]"


def valid(code: str) -> str:
    return f"(regexp_full_match({code}, '[A-Z]{{4}}') AND {code} NOT IN ({NOT_AIRPORTS}) AND regexp_matches({code}, '^(?:K|{REGIONS})'))"
