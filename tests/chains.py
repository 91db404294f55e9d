"""Chain texts that tests share. Every gap differs between the sides, so that a wrong side or offset shows.

Blocks: PLUS has chr7 [5000, 5120) to 12000, [5150, 5230) to 12165, [5290, 5430) to 12320, chr9 [300, 335) to 610, [350, 390) to 655;
MINUS chr9 [1100, 1170) to [7030, 7100), [1195, 1290) to [6915, 7010), turned; BOTH_MINUS scafQ [500, 560) to scafR [825, 885),
[410, 480) to [730, 800). BACK leads the first block of PLUS back.
"""

PLUS = """chain 4210 chr7 90000 + 5000 5430 chr7 95000 + 12000 12460 21
120 30 45
80 60 75
140

chain 77 chr9 4000 + 300 390 chr9 4100 + 610 695 22
35 15 10
40
"""
MINUS = """chain 350 chr9 7000 + 1100 1290 chr9 8000 - 900 1085 31
70 25 20
95
"""
BOTH_MINUS = """chain 12 scafQ 600 - 40 190 scafR 900 - 15 170 8
60 20 25
70
"""
BACK = """chain 5 chr7 95000 + 12000 12120 chr7 90000 + 5000 5120 1
120
"""
