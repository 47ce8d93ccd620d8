"""Test relations derived from the driver's tables, by SQL that Spark and DuckDB read alike."""

DOSSIER = r"""
SELECT o_orderkey AS doc_id, o_custkey AS case_id,
 'Sprawa: ' || CASE o_custkey % 4 WHEN 0 THEN 'James' WHEN 1 THEN 'Emma' WHEN 2 THEN 'Jana' ELSE 'Lucas' END || ' '
 || CASE o_custkey % 3 WHEN 0 THEN 'Kowalski' WHEN 1 THEN 'Dvořák' ELSE 'Smith' END
 || ', PESEL ' || lpad(cast(44051400000 + o_orderkey * 7919 AS string), 11, '0')
 || ', NIP ' || lpad(cast(1000000000 + o_orderkey * 104729 AS string), 10, '0')
 || ', REGON ' || lpad(cast(100000000 + o_orderkey * 7919 AS string), 9, '0')
 || ', konto PL' || lpad(cast(o_orderkey % 97 AS string), 2, '0') || lpad(cast(o_orderkey * 104729 AS string), 24, '0')
 || chr(10) || 'Adres: ul. Długa ' || cast(1 + o_orderkey % 200 AS string) || ', ' || lpad(cast(o_orderkey % 100 AS string), 2, '0') || '-' || lpad(cast(o_orderkey % 1000 AS string), 3, '0')
 || ', przebywa w ' || CASE o_orderkey % 3 WHEN 0 THEN 'London' WHEN 1 THEN 'Praha' ELSE 'Milton Keynes' END || ' od lat. Tel. +48 ' || cast(500 + o_orderkey % 99 AS string) || ' 234 ' || lpad(cast(o_orderkey % 1000 AS string), 3, '0')
 || ', mail: żuk' || cast(o_custkey % 50 AS string) || '@Firma' || cast(o_custkey % 7 AS string) || '.example.com, IP 10.0.' || cast(o_orderkey % 300 AS string) || '.7'
 || chr(10) || cast(o_orderkey % 30 AS string) || chr(10)
 || 'Dowód ABS' || lpad(cast((o_orderkey * 7919) % 1000000 AS string), 6, '0') || ', paszport AB' || lpad(cast(o_orderkey AS string), 7, '0')
 || ', KRS 000' || lpad(cast(o_orderkey AS string), 7, '0') || ', KW WA1M/' || lpad(cast(o_orderkey AS string), 8, '0') || '/' || cast(o_orderkey % 10 AS string)
 || ', akta II C ' || cast(1 + o_orderkey % 999 AS string) || '/24, działka nr ' || cast(1 + o_orderkey % 99 AS string) || '/2, PWZ ' || lpad(cast(o_orderkey AS string), 7, '0')
 || ', VIN WVWZZZ1JZXW' || lpad(cast(o_orderkey AS string), 6, '0') || ', AE:PL-AB1C2-D3E4F-G5H6I-J' || cast(o_orderkey % 10 AS string)
 || ', @jan_' || cast(o_custkey AS string) || ', prawo jazdy nr ' || lpad(cast(o_orderkey AS string), 5, '0') || '/24, znak sprawy: AB.' || cast(o_orderkey AS string) || '.24, https://x.example/' || cast(o_orderkey AS string)
 || ', umowa Alpha Sp. z o.o. i Urząd Miasta, auto WA ' || lpad(cast(o_orderkey % 100000 AS string), 5, '0') || '.' || chr(10) || 'Strona 1 z 3' AS text
FROM orders
"""
