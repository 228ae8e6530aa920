"""A library's loans, and rules about them."""

LOANS = """loan,group,tariff,lent_on,booked_on,shelves,scanned,branch,desk
L1,Student,S1,2021-03-04,04.03.2021,h3|h9,h9|h3,Nord,N
L2, student ,S1,2021-03-05,2021-03-05,k1,k1,Sued,S
L3,Adult,A1,2021-03-06,2021-03-07,k2|k4,k4|k2,West,W
L4,STUDENT,S1,11.03.2021,2021-03-11,k1|k1,k1,Nord,N
L5,Child,C1,soon,2021-03-12,,,West,W
L6,Student,A1,2021-03-13,2021-03-13,m1|m2,m1,Ost,O
L7,Guest,G1,2021-03-14,2021-03-14,m5,m5,Sued,S
"""

LOAN_RULES = """
# what separates the items of a list
defaults {
  separator = "|"
}
rule "tariff of a group" {
  mapping = auto
  transform_left = trim | lower
  left = group
  right = tariff
}
rule "desk of a branch" {
  left = branch
  right = desk
  mapping_files = [north, south]
  mapping_left = name
  mapping_right = sign
}
rule "lent and booked on one day" {
  left = lent_on
  right = booked_on
  transform_left = date(["%d.%m.%Y", "%Y-%m-%d"], "%Y%m%d")
  transform_right = date(["%d.%m.%Y", "%Y-%m-%d"], "%Y%m%d")
}
rule "all that was lent was scanned" {
  multi = true
  left = shelves
  right = scanned
}
"""

DESKS = {"north": "name,sign\nNord,N\nWest,W", "south": "name,sign\nSued,S\nOst,O\nNord,N2"}
