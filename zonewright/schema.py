"""Schemas of the tables the engine reads and keeps."""

from __future__ import annotations

LOCATION = "id string, name string, lat double, lon double, type string, loc_idx int, client_idx int"
VISIT = (
    "client_id long, finflux_address_id string, village_latitude double, village_longitude double, latitude_branch double, "
    "longitude_branch double, due_date timestamp, assigned_loan_officer_id long, Branch string"
)
RING = "array<struct<x:double,y:double>>"
WARD = f"ord int, pcode string, name string, township string, township_pcode string, rings array<{RING}>"
EDGE = "src string, dst string, border_length_km double, road_distance double, straight_distance double, detour_ratio double, score double"
EARTH_KM = 6371.0
#: Kilometres in a degree of border.
DEGREE_KM = 110.0
#: Road to straight distance where no road is known: between clients, and to a ward without clients.
ROAD_FACTOR, WARD_FACTOR = 1.3, 1.4
